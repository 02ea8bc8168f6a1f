"""Operators for preparing language-model training data; nothing else in tidewake imports this."""
