"""A PySpark-native engine for bitemporal geo-day panels."""
