"""A PySpark-native engine that turns discovered pages and posts into a small,
versioned, ranked table of distinct events."""
