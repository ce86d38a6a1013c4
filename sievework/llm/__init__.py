"""Corpus preparation for language-model training: ten operators and a pipeline."""
