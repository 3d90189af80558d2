"""Query catalog and end-to-end plans.

``catalog`` holds the registry (Spark plan + DuckDB oracle per query); the
``q_*`` modules register the queries by area: panels, features, splits,
metrics, models, monitors, sinks, streaming and the volume panel.
``comparison`` holds the end-to-end model comparison and univariate baseline;
``sqlgen`` builds the oracle SQL from the same panel specs.
"""
