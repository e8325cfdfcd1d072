"""evigraph: evidence-graph analytics and corpus preparation as composable Spark DataFrame transformations."""
