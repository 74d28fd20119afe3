"""Back-of-the-book indexing and index-quality analytics as Spark DataFrame operations."""
