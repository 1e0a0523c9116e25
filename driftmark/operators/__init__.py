"""Operators over observations, fields and tracks."""
