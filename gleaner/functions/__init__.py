"""Column-level building blocks: native expressions plus a few Arrow UDFs."""
