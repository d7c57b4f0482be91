"""Operators for preparing training data: one module per operator, their queries in ``queries``.

Nothing outside this package imports it. Each operator module has a general interface; the module
``queries`` derives the registered digest columns from it.
"""
