"""Operators of a training-data pipeline: one module per operator, all on whole tables.

Nothing outside this subpackage imports it. ``queries`` and ``oracles`` register the operators.
"""
