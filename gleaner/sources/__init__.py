"""Readers for document, Q&A XML and article dumps."""
