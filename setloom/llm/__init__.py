"""Operators that prepare text corpora for training: one module each, plus their queries."""
