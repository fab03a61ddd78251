"""Bulk dictionary-driven analysis of Japanese text on Spark.

``sources`` reads dictionaries and grammars, ``plans`` resolves the grammar,
``operators`` match, segment, rank and assemble, ``functions`` are Column
expressions, ``streaming`` holds the stateful variants.
"""
