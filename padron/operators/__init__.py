"""DataFrame transforms, one module per subject."""
