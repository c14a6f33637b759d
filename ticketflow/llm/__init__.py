"""Training-data operators: text extraction, filtering, dedup, mixing, encoding."""
