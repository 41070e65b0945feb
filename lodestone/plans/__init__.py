"""Ready-made plans over the tables, registered by name."""
