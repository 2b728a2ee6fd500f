"""weftline: a PySpark-native engine for graph-augmented retrieval over document corpora."""
