"""Readers and writers: file trees, strict reports, runs."""
