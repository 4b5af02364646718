"""User-level operators, one module per job."""
