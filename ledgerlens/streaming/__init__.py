"""Incremental (Structured Streaming) runs of the monthly questions."""
