"""plans of the corpuslens package."""
