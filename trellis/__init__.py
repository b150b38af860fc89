"""trellis: property-graph, search and temporal analytics on the Spark DataFrame API."""
