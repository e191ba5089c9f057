"""Training-data operators: search, de-duplication, tokens, scans and models over document tables."""
