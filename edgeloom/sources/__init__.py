"""Tables: the catalog, stored tables, bulk loading, single-row inserts."""
