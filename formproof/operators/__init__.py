"""Operators, one module per family; docstrings carry the operator ids."""
