"""Readers of editions and treebanks, and writers."""
