"""Operators over point, cell, mesh and matrix tables."""
