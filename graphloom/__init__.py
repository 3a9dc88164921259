"""Graph-shaped analytics as Spark plans."""
