"""Sources: scenes derived from tables, and readers of scene files."""
