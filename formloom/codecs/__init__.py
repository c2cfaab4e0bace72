"""Byte formats: pure functions over one file, used by sources and sinks on executors."""
