"""Training-data operators: dedup, decontamination, mixing, language and quality models, sharding."""
