"""Operators for training-data pipelines, and their registered queries.

Nothing outside this folder imports it, except the guarded block in
``__spark_entry__.py``.
"""
