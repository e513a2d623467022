"""A Spark-native engine for event logs, bitemporal graphs and verbatim text collections."""
