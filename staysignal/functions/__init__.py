"""Column-level building blocks (pure ``Column`` expressions, no actions)."""
