"""Relational operators over source files, diagnostics, symbols and test outcomes."""
