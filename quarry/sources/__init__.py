"""Readers and writers of corpora, snapshots and labelled queries."""
