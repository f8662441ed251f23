"""The queries over the test tables; importing the package registers them all."""

from tabforge.catalog import blocks, columns, ensembles, lookups, preprocess, splits, statistics, trees
from tabforge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "blocks", "columns", "ensembles", "lookups", "preprocess",
           "splits", "statistics", "trees"]
