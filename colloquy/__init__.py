"""Dialogue data work as plain Spark jobs: read, clean, split, mix, pack, score, stream."""
