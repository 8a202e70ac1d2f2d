"""Training-data operators: scoring, deduplication, decontamination, quality, archives, tokens, chat and packing."""
