"""Table registry and the registered queries with their oracles."""
