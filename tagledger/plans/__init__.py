"""Session settings, shared storage and whole flows."""
