"""Operators on tables of images, patches and scores.  Each takes and returns DataFrames."""
