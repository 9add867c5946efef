"""PySpark-native engine for paired-endpoint, embedding and text-corpus analytics."""
