"""Carrier views over the driver tables and the catalogue of registered queries."""
