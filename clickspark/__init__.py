"""clickspark: clickstream analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame``.  Most are lazy; those
that need a bounded summary first (quantiles, scalars, ranks, model fits) run
jobs when called and bring that summary, never rows, to the driver.
Sub-packages:

* ``functions``  scalar/column helpers (rounding rules, guarded ratios, bins)
* ``sources``    CSV / Parquet / JSON readers and writers, file inventory
* ``operators``  the analyses (profiling, funnels, sessions, sequences,
                 users/RFM, features, value, models, boosted trees), the
                 global rank and radix-selected quantiles
* ``plans``      the named query registry and its SQL oracle
* ``streaming``  incremental ingest of new raw files with Structured Streaming
"""

__version__ = "0.1.0"
