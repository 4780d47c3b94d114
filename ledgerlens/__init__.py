"""Ledger analytics on Spark DataFrames.

Raw delimited ledger lines (transactions, contracts, blocks) and address
catalogues are parsed with Python ``int()``-compatible validation, bucketed by
UTC month, aggregated exactly with ``decimal(38,0)`` and joined with address
lists while keeping join multiplicity.  Everything is expressed with DataFrame
operations so Catalyst plans it; there are no Python UDFs.
"""

from ledgerlens.session import checkpoint_dir, local_session

__all__ = ["checkpoint_dir", "local_session"]
