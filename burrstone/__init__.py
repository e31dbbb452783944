"""burrstone: a PySpark-native engine for relational, graph-shaped and array workloads."""
