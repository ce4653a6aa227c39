"""Where tables come from: typed loads, lookups, derived health tables, log tables, writers."""
