"""clinloom — clinical-note preparation and evaluation as Spark DataFrame jobs.

Sub-packages:
  sources    readers, writers and the fixture views used by tests
  functions  pure ``Column -> Column`` expressions (text cleaning, dates, arrays)
  operators  ``DataFrame -> DataFrame`` building blocks (filters, joins, aggregates,
             dedupe, sampling, labels, sequences, metrics, embeddings)
  plans      composed jobs (ICD dataset, MLM corpus, radiology linkage, ...)
  streaming  the stateless operators applied to a file stream
"""

from clinloom.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
