"""Independent SQL for every batch query, in the dialect of the single-node checker.

Nothing here is used by the library. Each expected result is written as plain SQL over the star
tables; shared table expressions live in ``tables`` and are pulled in by name.
"""
