"""Training-data operators: the thirteen numbered operators, their queries and their SQL.

Nothing else in the package imports this subpackage.
"""
