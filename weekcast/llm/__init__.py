"""Training-data operators: cleaning, deduplication, scanning and output of text corpora.

Nothing else in the library imports this subpackage.
"""
