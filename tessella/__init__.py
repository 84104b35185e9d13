"""A PySpark-native analytics engine for media-library catalogues."""
