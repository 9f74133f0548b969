"""A PySpark-native engine that builds and curates question/answer corpora."""
