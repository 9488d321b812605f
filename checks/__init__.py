"""The library's operators run over the driver tables, and SQL to check them."""
