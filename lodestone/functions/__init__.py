"""Column expressions: text features, tokens, relevance."""
