"""Column functions: digests, codecs, names and paths, statistics. Built-in expressions wherever Spark has them."""
