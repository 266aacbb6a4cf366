"""Moving-object analytics on wide-area imagery, expressed as Spark jobs."""
