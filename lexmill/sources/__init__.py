"""Readers: everything arrives as a DataFrame of documents, pages or responses."""
