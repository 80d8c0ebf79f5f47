"""Column helpers: guarded arithmetic, full-window rolling expressions, decay sums."""
