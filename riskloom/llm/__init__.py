"""Operators for preparing language-model training corpora (see the README's table)."""
