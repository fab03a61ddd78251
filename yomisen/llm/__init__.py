"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Every operator takes DataFrames and
returns DataFrames; the contract queries live in :mod:`yomisen.llm.queries`.
"""
