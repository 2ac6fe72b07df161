"""basinsift llm"""
