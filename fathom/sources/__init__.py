"""Readers with stated schemas, and writers."""
