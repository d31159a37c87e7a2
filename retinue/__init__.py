"""retinue: image retrieval, log, graph and text analytics as Spark DataFrame jobs."""
