"""biblioforge: a PySpark-native engine for citation records, record linkage and its analytics."""
