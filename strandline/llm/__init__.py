"""Operators for the training data of language models; nothing outside imports this subpackage."""
