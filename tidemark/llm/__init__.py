"""Operators for preparing training data: one module for each, and `queries` that registers them.

Nothing outside this subpackage imports it.
"""
