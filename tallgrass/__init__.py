"""Tallgrass: context analytics (retrieval, graph, event, memory, change-data and text operators) on PySpark."""
