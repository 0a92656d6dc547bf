"""Training-data operators: filters, scoring, deduplication, decontamination and mixing."""
