"""Decoders of ingest formats, and the signals derived from tables."""
