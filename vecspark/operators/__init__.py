"""Query operators on vector tables."""
