"""sources/adapters."""
