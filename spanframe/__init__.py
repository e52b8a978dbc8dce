"""A PySpark-native document annotation and entity extraction engine."""
