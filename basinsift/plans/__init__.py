"""basinsift plans"""
