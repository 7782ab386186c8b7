"""drift_atlas: comparison of collections through the vector distributions they induce, on Spark."""
