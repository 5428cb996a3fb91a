"""Tessera: a Spark-native engine that indexes a corpus of source files and answers ranked searches over it."""
