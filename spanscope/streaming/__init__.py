"""Influence profiles over streams."""
