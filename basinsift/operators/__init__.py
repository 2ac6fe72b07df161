"""basinsift operators"""
