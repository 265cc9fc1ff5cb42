"""Operators on sequences: DataFrames with a dense position ``pos`` from 0 and a value ``v``.

Predicates and operations are functions of Columns.  Results that are one value are frames of one row
with the column ``result``; positions not found are the length of the sequence.
"""
