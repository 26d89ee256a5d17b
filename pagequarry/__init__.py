"""Spark jobs that turn tables of web pages and documents into clean Markdown and query it."""
