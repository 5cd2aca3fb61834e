"""Operators for preparing large text corpora; each module holds one operator.

Nothing outside this folder imports it.
"""
