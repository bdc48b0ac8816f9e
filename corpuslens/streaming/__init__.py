"""streaming of the corpuslens package."""
