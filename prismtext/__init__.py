"""Text privacy and prompt analytics as Spark DataFrame transforms."""
