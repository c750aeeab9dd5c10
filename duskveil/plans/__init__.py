"""Shared building blocks that keep big plans parallel."""
