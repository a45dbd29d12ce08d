"""quarry: PySpark-native document-corpus analytics and filtered vector retrieval."""
