"""Operators of a training-data pipeline: one module per operator, registered in ``plans``.

Nothing else in the library imports this subpackage.
"""
