"""cohortlens: cohort / longitudinal-performance analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from built-in Spark
expressions; column names are parameters.  Sub-packages:

- ``sources``   scans, validation, sinks, generators, default fills
- ``functions`` Column-expression helpers (row-wise means, decoders, bins, ...)
- ``operators`` reshape, clean, joins, aggregates, profiles, statistics,
                encoders, numeric transforms, splits, models, rules
- ``plans``     the composed entry points (star-schema ETL, training, scoring)
                and the registered fixture queries
- ``streaming`` incremental batch scoring over arriving files
"""

__version__ = "0.1.0"
