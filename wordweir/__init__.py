"""Word profiles of large text corpora on Spark: scan, profile, merge, and queries such as the first word that does not repeat."""
