"""Panel analytics on Spark: features, inference, portfolios and monitoring for
long (date x symbol) tables, expressed with DataFrames, windows and MLlib."""
