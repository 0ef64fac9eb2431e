"""Vector collections, search and data preparation as Spark plans."""
