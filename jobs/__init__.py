"""Runnable jobs over the given tables: ``python -m jobs.chunk_table`` and ``python -m jobs.grow_index``."""
