"""Column expressions: no shuffle, no Python worker, usable in batch and streams."""
