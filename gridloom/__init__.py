"""Gridloom: corridor analytics over rasters, vector layers and routes as Spark DataFrames."""
