"""Driver tables, JSON lines and the versioned store."""
