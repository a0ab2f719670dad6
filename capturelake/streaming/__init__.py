"""Structured Streaming forms of the stage, run, upload and scoring tables."""
