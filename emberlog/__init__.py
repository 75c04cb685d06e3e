"""emberlog: Spark jobs that investigate large log collections."""
