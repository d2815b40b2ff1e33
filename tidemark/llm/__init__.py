"""Training-data operators: mixing, tokenising, sharding, chat, fingerprints, secrets, search, dedup, language, archives."""
