"""Expressions and kernels: polygons, rasters, text and numbers."""
