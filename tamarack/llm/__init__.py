"""Training-data operators: cleaning, mixing, tokenizing and storage at corpus scale."""
