"""Column expressions: boxes, polygons, vectors, scores, names and times."""
