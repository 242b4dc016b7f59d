"""Document collections on Spark: filters, projections, grouped aggregations and pipelines over lazy DataFrames."""
