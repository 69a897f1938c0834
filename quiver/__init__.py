"""quiver: cross-modal retrieval and retrieval evaluation on Spark.

Records carrying an image vector and a text vector are fanned out into three
modality views, fused and normalised with Catalyst expressions, searched with
an exact (or cell-partitioned approximate) top-k inner-product join, and scored
against relevance judgments as hit-rate@k and MRR for every pairing of query
and candidate modality.

Sub-packages:
  functions  column expressions (vectors, text, ids)
  sources    driver tables, relevance judgments, sinks
  operators  DataFrame -> DataFrame operators (views, search, metrics, ...)
  plans      end-to-end jobs (evaluation grid, search cards)
  streaming  Structured Streaming search
"""

from quiver.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
