"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
