"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it. ``kilnframe.llm.registry`` lists
its queries and their SQL.
"""
