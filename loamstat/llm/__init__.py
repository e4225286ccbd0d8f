"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; it depends only on
PySpark, NumPy and PyArrow (and tiktoken for token counts) and can be removed as a whole.
"""
