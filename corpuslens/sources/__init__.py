"""sources of the corpuslens package."""
