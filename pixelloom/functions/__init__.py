"""Scalar rules of the raster engine as Column expressions."""
