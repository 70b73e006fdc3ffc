"""Operators that prepare text corpora for model training.

Each module holds one operator with a general interface; ``queries`` registers
thin queries that apply them to whole tables. Nothing else in the library imports
this subpackage.
"""
