"""bundlefold: a Spark-first engine for small-file archives and training-data pipelines."""
