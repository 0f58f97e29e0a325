"""Sources: table scans and the inputs derived from them."""
