"""Training-data operators: filtering, deduplication, scoring, tokenising and packing of text at corpus scale."""
