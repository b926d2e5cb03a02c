"""Sources and sinks: ledger extracts, register snapshots, CSV call lists and
the adapters that derive both inputs from the test tables."""

from churnscope.sources import fixtures
from churnscope.sources.ledger import (
    LEDGER_COLUMNS,
    LEDGER_SCHEMA,
    RAW_LEDGER_SCHEMA,
    cut,
    ledger_from_extracts,
    ledger_from_tagged,
    qualify,
    read_extract,
    read_ledger,
    to_ledger,
    union_extracts,
)
from churnscope.sources.register import (
    dated_register,
    duplicate_keys,
    normalise_register,
    read_register_snapshot,
    read_register_snapshots,
    unique_keys,
)
from churnscope.sources.sinks import read_call_lists, write_call_lists
from churnscope.sources.tables import read_bucketed, write_bucketed

__all__ = [
    "LEDGER_COLUMNS",
    "LEDGER_SCHEMA",
    "RAW_LEDGER_SCHEMA",
    "cut",
    "dated_register",
    "duplicate_keys",
    "fixtures",
    "ledger_from_extracts",
    "ledger_from_tagged",
    "normalise_register",
    "qualify",
    "read_bucketed",
    "read_call_lists",
    "read_extract",
    "read_ledger",
    "read_register_snapshot",
    "read_register_snapshots",
    "to_ledger",
    "union_extracts",
    "unique_keys",
    "write_bucketed",
    "write_call_lists",
]
