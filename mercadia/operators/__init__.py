"""Named DataFrame operators, one module per subject."""
