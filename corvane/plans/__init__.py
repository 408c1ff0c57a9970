"""Whole queries put together from the operators: the public API and the registered catalogue."""
