"""Operators for building training corpora: one module per operator, queries in :mod:`quarryline.llm.queries`.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames, reads its inputs
through Spark only and keeps intermediate tables in the shared folder named by ``spark.checkpoint.dir``.
"""
