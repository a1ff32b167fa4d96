"""Training-data operators: decontamination, deduplication, language and quality models, tokenization, chat formatting."""
