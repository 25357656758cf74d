"""The ledger's named queries. Importing this package registers them."""

from tallywright.plans import ingest, ledger, reads  # noqa: F401
from tallywright.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
