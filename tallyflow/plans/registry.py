"""All registered queries of the record analytics and their SQL."""

from tallyflow.plans import evaluation, graphs, labelled, records  # noqa: F401
from tallyflow.plans.base import QUERIES, SQL

FLAGSHIP = "g4_linked_wallets"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
