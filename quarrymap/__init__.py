"""quarrymap: a PySpark-native engine for facts about code bases."""
