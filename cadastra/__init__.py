"""cadastra: a Spark-native engine for change-notice text, yearly panels and corpus work."""
