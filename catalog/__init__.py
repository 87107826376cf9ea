"""Registered queries: every operator over the driver tables, with the SQL that checks it."""
