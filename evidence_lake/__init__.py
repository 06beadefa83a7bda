"""PySpark-native engine for evidence-grounded analysis of document collections."""
