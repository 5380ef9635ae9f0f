"""Operators over influence tables."""
