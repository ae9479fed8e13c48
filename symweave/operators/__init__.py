"""Relational operators over files, symbols, calls and vectors."""
