"""A Spark-native evidence-graph and lineage engine."""
