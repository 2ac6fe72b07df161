"""basinsift ."""
