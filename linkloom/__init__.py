"""linkloom: dependency-graph analytics written as Spark jobs."""
