"""Operators for preparing language-model training corpora with Spark.

Nothing outside this subpackage imports it.
"""
