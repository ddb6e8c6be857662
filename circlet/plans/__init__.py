"""Driver-side planning: curve ranges of a box, trees, parameter search."""
