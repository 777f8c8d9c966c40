"""tessera: document knowledge-base analytics written for Spark."""
