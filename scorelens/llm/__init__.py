"""Training-data operators over text corpora."""
