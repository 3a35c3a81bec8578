"""Spark-native analytics for multi-round nucleic-acid selection sequencing."""
