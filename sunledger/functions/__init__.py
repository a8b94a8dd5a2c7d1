"""Column builders: clock, solar geometry, scores and small statistics."""
