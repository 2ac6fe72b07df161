"""basinsift sources"""
