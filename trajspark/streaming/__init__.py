"""Structured Streaming jobs: new-state ingest, live metrics, episode assembly, resumable runs."""
