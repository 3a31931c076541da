"""Training-data operators: exact and near dedup, quality, mixing, tokenizing, secrets, urls."""
