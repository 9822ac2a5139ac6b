"""Scalar functions over columns: ids, links, dates, metadata and labels."""
