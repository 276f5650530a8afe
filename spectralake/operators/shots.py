"""Choosing shots: ranges, lookups, unfinished work."""

from pyspark.sql import functions as F


def select_shots(index, first, last):
    """Shots of the index inside ``[first, last]``."""
    return index.where(F.col("shot").between(first, last))


def is_empty(shots):
    """Whether a range holds no shot."""
    return shots.isEmpty()


def lookup(index, number):
    """One shot; no row when it is not indexed. Prunes to its folder in a shot store."""
    return index.where(F.col("shot") == number)


def pending(shots, done, overwrite=False):
    """Shots without output yet; all of them when overwriting."""
    return shots if overwrite else shots.join(done.select("shot"), "shot", "left_anti")
