"""corpusloom: corpus curation, text rules and event analytics as Spark plans."""
