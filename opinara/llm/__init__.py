"""Operators for building training corpora: cleaning, filtering, joining, packing and scoring of documents."""
