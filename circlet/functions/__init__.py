"""Column builders: curves, coordinates, distances."""
