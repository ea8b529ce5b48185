"""Text-to-place retrieval analytics on Spark: grids, vector search, spatial joins and retrieval evaluation."""
