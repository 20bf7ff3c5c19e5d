"""The library's queries over the driver's tables, and their SQL twins."""
