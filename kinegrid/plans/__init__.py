"""Registered queries: the operators applied to the test tables, with the SQL that each must equal."""
