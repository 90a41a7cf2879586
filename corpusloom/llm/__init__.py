"""Operators that prepare documents for model training, one module each."""
