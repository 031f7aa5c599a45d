"""Relational and data-processing operators on the DataFrame and SQL API of Apache Spark."""
