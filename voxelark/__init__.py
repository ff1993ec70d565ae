"""Spatial and multiresolution analytics over DataFrames keyed by octree cell."""
