"""A PySpark-native engine for financial-statement analytics."""
