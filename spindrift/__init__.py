"""Spindrift: building, querying and auditing semantic indexes over text corpora, as Spark DataFrames."""
