"""Analytics on annotated cell-by-gene matrices, as Spark DataFrames."""

from .sources.store import Store, dense_store, sparse_store

__all__ = ["Store", "dense_store", "sparse_store"]
