"""Column functions on text: folding, tokens, marks, the posting codec."""
