"""Column expressions: key hashes, metrics and rule flags."""
