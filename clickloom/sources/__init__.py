"""Sources: typed tables, raw requests, postbacks, service logs."""
