"""Training-data operators: ten numbered operators, one module each.

Nothing outside this subpackage imports it; `queries.py` registers its queries.
"""
