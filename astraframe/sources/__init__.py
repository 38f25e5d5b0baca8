"""Reading and writing files: storage, headers, decoding, the Spark data source."""
