"""Operators for preparing text at scale; nothing outside this subpackage imports it."""
