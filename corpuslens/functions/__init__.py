"""functions of the corpuslens package."""
