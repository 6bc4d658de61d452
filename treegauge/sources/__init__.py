"""Getting rows in: directory trees, file bytes, ignore files, events."""
