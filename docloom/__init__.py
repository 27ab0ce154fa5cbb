"""docloom: a Spark-native engine for preparing, mining and evaluating retrieval data."""
