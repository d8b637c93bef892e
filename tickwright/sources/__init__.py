"""Readers and writers: bar files, dimension files, instrument maps, prediction tables."""
