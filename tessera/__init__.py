"""Text embedding and reranking on Spark: DataFrame operators, sources, functions, plans and streaming twins."""
