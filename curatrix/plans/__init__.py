"""plans of the catalogue engine."""
