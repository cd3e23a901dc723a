"""Training-data operators: filtering, deduplication, decontamination, mixing and sharding."""
