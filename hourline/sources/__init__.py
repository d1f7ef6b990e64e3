"""Reading and writing files, tables and fitted models."""
