"""Import every catalogue group so QUERIES / ORACLE are complete."""

from tallyframe.plans import catalog, oracle
from tallyframe.plans import (  # noqa: F401
    group_clean, group_contracts, group_enrich, group_extra, group_insights, group_io, group_ledger, group_lookup)

QUERIES = catalog.QUERIES
ORACLE = oracle.resolve()
