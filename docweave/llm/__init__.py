"""Operators that prepare training data for language models, each over whole tables of documents or vectors."""
