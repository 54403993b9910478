"""Change streams over the persisted log, and live reads of it."""
