"""End-to-end jobs composed from the operators, and the query registry."""
