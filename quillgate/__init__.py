"""quillgate: a PySpark-native document-analytics engine."""
