"""Tables of points, their layouts, and the circular range query."""
