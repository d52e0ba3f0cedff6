"""tempograph: temporal history and provenance-preserving retrieval as Spark plans."""
