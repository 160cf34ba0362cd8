"""A PySpark-native engine for document retrieval and fault-diagnosis graphs."""
