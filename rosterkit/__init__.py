"""rosterkit: turn large deliveries of messy person files into clean rosters, as Spark jobs."""

__version__ = "0.1.0"
