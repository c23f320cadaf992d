"""Column functions: text coercion, keys, tokenizers."""
