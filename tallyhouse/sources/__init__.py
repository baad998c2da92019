"""Everything that reads or writes: given tables, bronze, the catalog, exports."""
