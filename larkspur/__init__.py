"""A Spark-native engine for commerce search, merchandising and behaviour analytics."""
