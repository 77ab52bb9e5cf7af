"""A Spark-native engine for curating a corpus of change records and retrieving earlier, similar ones."""
