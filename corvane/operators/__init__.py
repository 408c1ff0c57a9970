"""Relational operators: retrieval, verification, aggregation, evaluation, corpus preparation."""
