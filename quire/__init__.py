"""quire: structure-aware document analytics on PySpark.

Pages, Markdown and section lists become DataFrames keyed by ``(doc_id, pos)``;
chunking, parsing, verification, tree assembly and retrieval are Catalyst plans.
"""

__version__ = "0.1.0"
