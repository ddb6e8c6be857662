"""Readers and writers of points, queries, boxes and results."""
