"""Incremental ingestion, and memory of clinical cases between a conversation's messages."""
