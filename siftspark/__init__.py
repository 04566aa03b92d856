"""Spark-first retrieval and analysis of source code and text at corpus scale."""
