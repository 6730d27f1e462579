"""Column functions: tokenizers, paths, text edits, output handling."""
