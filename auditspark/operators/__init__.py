"""Stages of an audit; every function takes and returns DataFrames."""
