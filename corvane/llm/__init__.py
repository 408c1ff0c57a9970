"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps whole texts, and leaves per-document state on the executors.
"""
