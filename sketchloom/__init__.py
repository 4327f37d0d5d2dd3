"""A PySpark-native engine for synopses, stateful analytics and corpus preparation."""
