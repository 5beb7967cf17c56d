"""Column-level building blocks (no actions, no shuffles)."""
