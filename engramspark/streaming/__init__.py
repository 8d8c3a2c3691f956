"""Log shipping over the file source."""
