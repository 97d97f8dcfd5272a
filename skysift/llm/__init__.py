"""Training-data operators (HTML, quality, toxicity, tokens, dedup, secrets)."""
