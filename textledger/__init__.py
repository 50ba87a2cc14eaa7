"""A PySpark-native engine for versioned key/value text catalogs."""
