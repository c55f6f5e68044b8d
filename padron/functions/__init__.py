"""Column expressions: text, numbers, periods, chat records, hashes, scores."""
