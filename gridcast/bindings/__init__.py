"""The operators bound to the driver's tables, each with its equivalent SQL where one exists."""
