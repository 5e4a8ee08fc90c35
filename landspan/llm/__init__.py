"""Operators that prepare text for training language models, and their queries."""
