"""Training-data operators: search, archives, filters, language ID, tokens, quality, dedup, media copies and mixing."""
