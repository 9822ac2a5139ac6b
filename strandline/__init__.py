"""Strandline: a Spark-first engine for curating and evaluating labelled, time-annotated datasets."""

__version__ = "0.1.0"
