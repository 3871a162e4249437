"""Operators for building training corpora; nothing else in wavelot imports this subpackage."""
