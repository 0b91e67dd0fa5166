"""Readers: text books, EPUB archives, project documents."""
