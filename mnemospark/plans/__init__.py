"""End-to-end queries: table derivations, composed searches and the query registry."""
