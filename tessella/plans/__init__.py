"""Row order and the query catalogue."""
