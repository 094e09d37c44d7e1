"""Operators for building training corpora: text in, decisions, encodings and packings out."""
