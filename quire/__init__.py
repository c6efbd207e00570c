"""A PySpark-native engine for text corpora: catalogue, hierarchy, search, vectors, fragments, maintenance and state."""
