"""Training-data operators: filtering, deduplication, decontamination, counting and mixing."""
