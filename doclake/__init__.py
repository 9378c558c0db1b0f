"""doclake: document-corpus ingestion, retrieval and cited answers as Spark DataFrame operators."""

__version__ = "0.1.0"
