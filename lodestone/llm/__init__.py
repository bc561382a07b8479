"""Operators for large training corpora. Nothing outside this subpackage imports it."""
