"""tallyframe: Spark-native entity analytics.

Every operator is a ``DataFrame -> DataFrame`` function built from Catalyst
expressions.  Sub-packages:

* ``functions`` - column-expression helpers (rounding, null/NaN handling,
  text matching, vectors, banding).
* ``sources``   - table readers, stand-in views over the supplied tables,
  sinks.
* ``operators`` - the named transformations (fixtures, scoring, curation,
  cleaning, quality, enrichment, look-ups, insights, ledger, evaluation).
* ``plans``     - the query catalogue wired to ``__spark_entry__`` plus the
  DuckDB oracle SQL.
* ``streaming`` - Structured Streaming counterparts.
"""

from tallyframe.session import build_session, checkpoint_root  # noqa: F401
