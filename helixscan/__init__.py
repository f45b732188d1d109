"""helixscan: nearest-neighbour search over aligned sequences, written for Spark."""
