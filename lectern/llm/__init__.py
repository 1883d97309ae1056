"""Operators that prepare text for training: see the module of each problem.

Nothing outside this subpackage imports it.
"""
