"""Plan helpers: size-checked lookups, date pruning, latest row per key."""
