"""Operators for training data of language models; nothing else in tidegauge imports this folder."""
