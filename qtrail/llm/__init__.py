"""Training-data operators on Spark (near-dedup, quality, language, toxicity, tokens, packing)."""
