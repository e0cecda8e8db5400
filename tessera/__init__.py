"""Spark-first analytics over landed web pages, search responses, page outlines and request logs."""
