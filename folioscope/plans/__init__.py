"""Registered queries, the SQL that states their results, and frames for charts."""
