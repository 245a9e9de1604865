"""Training-data operators: language, duplicates, personal data, toxicity,
decontamination, mixing, extraction, secrets, quality and vector search."""
