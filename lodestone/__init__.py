"""lodestone: knowledge-graph corpus analytics on Spark DataFrames."""
