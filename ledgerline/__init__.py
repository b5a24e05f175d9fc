"""Provenance and record-integrity analytics over DataFrames."""
