"""Training-data operators: quality, extraction, formatting, archives, token files, decontamination, PII, dedup, packing."""
