"""Spark jobs that build, maintain and search a source-text corpus."""
