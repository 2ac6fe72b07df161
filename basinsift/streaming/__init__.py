"""basinsift streaming"""
