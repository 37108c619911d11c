"""Operators of a training-data pipeline over large document tables.

Nothing outside this folder imports it. Each module holds one operator; `queries` registers them over the given tables.
"""
