"""A Spark-native engine for code and document retrieval: index, search, fusion, context, evaluation, operations."""
