"""operators of the catalogue engine."""
