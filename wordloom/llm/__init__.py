"""Training-data operators: one module for each operator, `queries` for what the entry module registers.

Nothing outside this package imports it.
"""
