"""pathledger: a PySpark engine for versioned, content-addressed catalogs.

Snapshots of path trees, Merkle pages, pruned diffs, three-way reconcile, revision logs,
reachability sweeps, content-defined chunks and event feeds, all as DataFrames.
"""
