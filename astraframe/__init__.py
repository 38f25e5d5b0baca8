"""A Spark-native engine for Flexible Image Transport System files."""
