"""Operators for training data: splits, defects, sketches, splitting, normal forms, tokens, leaks, toxicity."""
