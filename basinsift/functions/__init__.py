"""basinsift functions"""
