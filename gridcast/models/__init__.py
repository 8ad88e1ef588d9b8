"""Per-zone models: least squares, trees, response fits, evaluation."""
