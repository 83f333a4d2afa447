"""Ontology queries and knowledge-graph processing as Spark DataFrame plans."""

__version__ = "0.1.0"
