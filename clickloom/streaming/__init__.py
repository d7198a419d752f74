"""The batch computations on streams."""
