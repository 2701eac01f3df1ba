"""Operators for preparing training corpora: documents, pages, benchmark, labels."""
