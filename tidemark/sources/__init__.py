"""Snapshots, tables, commits, warehouses; import from the modules."""
