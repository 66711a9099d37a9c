"""Operators for preparing language-model training text, as Spark jobs.

One module per operator; :mod:`queries` registers one query for each.
Nothing outside this subpackage imports it.
"""
