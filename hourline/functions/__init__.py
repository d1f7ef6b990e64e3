"""Column expressions: no DataFrame is read or written here."""
