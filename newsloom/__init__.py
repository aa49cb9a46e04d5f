"""newsloom: Spark-native analytics over news items and their rewritten versions."""
