"""Operators for preparing large text corpora.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.  Every operator selects the columns it needs by name at the
start; where whole rows come back they travel as one struct.  So extra columns never
clash with its own.
"""
