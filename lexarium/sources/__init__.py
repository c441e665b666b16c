"""Readers, the reader registry and the vector store."""
