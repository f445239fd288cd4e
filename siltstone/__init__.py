"""A Spark-native engine for relational, retrieval, graph and text queries."""
