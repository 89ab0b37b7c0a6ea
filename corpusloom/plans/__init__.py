"""The operators bound to tables: queries, and the SQL that must give the same rows."""
