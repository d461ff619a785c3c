"""quillon: a PySpark-native analytics engine.

Sub-packages: ``functions`` (scalar and array column expressions),
``operators`` (joins, merges, as-of matching, aggregates), ``sources``
(record-format readers and writers), ``plans`` (registered relational
queries), ``streaming`` (event-time operators) and ``llm`` (training-data
operators, which nothing else here imports).
"""
