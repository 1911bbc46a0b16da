"""sceneloom: a Spark-first query, dataset and verification engine for typed scenes at scale."""

__version__ = "0.1.0"
