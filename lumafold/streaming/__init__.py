"""Structured Streaming: shot streams to frames, resumable frame by frame."""
