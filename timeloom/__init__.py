"""Timeline analytics and media-index processing on PySpark."""
