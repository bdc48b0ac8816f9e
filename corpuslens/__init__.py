"""corpuslens: Spark jobs for large collections of source trees and text corpora."""
