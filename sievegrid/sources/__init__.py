"""Readers and writers of releases, market indexes, sparse features, evidence and provenance."""
