"""revlens: review analytics expressed as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark's own
expressions, aggregations, joins and ML, so it runs inside whole-stage codegen
and scales with the cluster. Chain them with ``df.transform``.
"""

from revlens.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
