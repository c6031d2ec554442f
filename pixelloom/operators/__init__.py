"""Filters, histograms, tiling, quality measures and bench analytics over DataFrames."""
