"""Driver-table mapping and the registry of named queries."""
