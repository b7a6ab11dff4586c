"""docframe: documents to typed, key-linked tables on Spark."""
