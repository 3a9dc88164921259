"""Operators for large training corpora.

Nothing else in the package imports this subpackage; its queries reach the
driver contract through :mod:`graphloom.llm.queries`.
"""
