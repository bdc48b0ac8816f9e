"""operators of the corpuslens package."""
