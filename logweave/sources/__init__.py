"""Sources: byte-exact line source and encodings."""
