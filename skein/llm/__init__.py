"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it; delete the folder and the rest of
the library still works.
"""
