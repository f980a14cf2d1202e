"""almagest: a PySpark-native engine for claims about what happened, when, where and according to whom."""
