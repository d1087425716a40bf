"""Sources: file trees, sidecars, small stores, file content."""
