"""Single-cell analytics on Spark: lazy DataFrames over long (cell, gene, value) tables."""
