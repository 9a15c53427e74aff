"""Operators on text corpora for training data; nothing outside this subpackage imports it."""
