"""Source repositories as tables and property graphs, queried with Spark."""
