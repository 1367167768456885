"""PySpark-native engine for domain annotation of linear coordinate systems."""
