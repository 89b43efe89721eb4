"""Training-data operators: extraction, tokenisation, deduplication, decontamination,
language identification and pseudonyms. Nothing else in the library imports this package."""
