"""Resource-graph changefeeds expressed as Spark jobs."""
