"""gleaner: document retrieval and its evaluation as batch Spark jobs."""
