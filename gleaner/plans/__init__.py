"""Multi-step flows and the registry of named queries."""
