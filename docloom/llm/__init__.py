"""Operators for training text; nothing else in docloom imports this subpackage."""
