"""Operators for preparing language-model training text. Nothing else in loomwork imports this package."""
