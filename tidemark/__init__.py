"""tidemark: Spark-native product and e-commerce analytics.

Layout
------
- ``tidemark.sources``   table schemas, readers / writers, the mapping from the
                          driver's test tables to the five-table app model.
- ``tidemark.functions`` column helpers (rounded ratios, optional filters).
- ``tidemark.operators`` reusable DataFrame operators (sessionisation, stage
                          flags, prior-order counts, audits).
- ``tidemark.plans``     the session mart, the reports, the ML pipeline and
                          the named report registry.
- ``tidemark.streaming`` intentionally empty (the reference has no streaming).
"""

from tidemark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
