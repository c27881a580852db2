"""Structured Streaming: message sources, micro-batches, deduplication and batch cleaning."""
