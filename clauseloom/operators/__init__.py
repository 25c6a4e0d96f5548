"""DataFrame-level operators, one module per area."""
