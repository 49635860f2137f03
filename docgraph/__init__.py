"""docgraph: documentation retrieval as Spark plans."""
