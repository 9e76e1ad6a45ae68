"""Whole flows, queries bound to the driver's tables, and the SQL each is checked with."""
