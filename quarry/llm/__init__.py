"""Operators for very large training corpora.  Nothing outside this folder imports them."""
