"""Training-data operators: packing, filters, duplicates, tokenising, scoring and chat formatting."""
