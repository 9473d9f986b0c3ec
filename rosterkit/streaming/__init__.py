"""Structured Streaming jobs: scan requests and delivered files as they appear in a folder."""
