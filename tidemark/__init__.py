"""Event-log analytics on Spark: ordered reads, folded projections, typed queries, decisions and delivery."""
