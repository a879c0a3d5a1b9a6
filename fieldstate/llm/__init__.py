"""Training-data operators: deduplication, filtering, decontamination, extraction, archives and packing."""
