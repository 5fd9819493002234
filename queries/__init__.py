"""Registered queries: the library's operators on the driver's tables, each with its SQL twin."""
