"""Readers and writers of point, mesh, grid and image files."""
