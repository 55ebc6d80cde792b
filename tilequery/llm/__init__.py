"""Training-data operators: thirteen DataFrame operators and their driver queries.

Nothing else in the library imports this subpackage.
"""
