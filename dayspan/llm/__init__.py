"""Training-data operators: cleaning, near duplicates, mixing, chat and token files."""
