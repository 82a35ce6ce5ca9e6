"""Similarity analytics over large collections of submissions, as Spark DataFrame jobs."""
