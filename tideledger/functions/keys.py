"""Identity strings, digests and stable payload text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_key(chain_id="chain_id", block_hash="block_hash", tx_hash="tx_hash", log_index="log_index") -> Column:
    return F.concat_ws(
        ":", F.col(chain_id).cast("string"), F.col(block_hash), F.col(tx_hash), F.col(log_index).cast("string")
    )


def position_key(chain_id="chain_id", account_id="account_id", perpetual_id="perpetual_id") -> Column:
    return F.concat_ws(
        ":", F.col(chain_id).cast("string"), F.col(account_id).cast("string"), F.col(perpetual_id).cast("string")
    )


def empty_key_part(*names: str) -> Column:
    """True when one of the text parts of a key is missing or blank."""
    found = F.lit(False)
    for name in names:
        found = found | F.col(name).isNull() | (F.trim(F.col(name)) == "")
    return found


def digest_text(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def digest_json(value: Column) -> Column:
    """SHA-256 of the compact JSON of a struct or array, nulls kept."""
    return digest_text(F.to_json(value, {"ignoreNullFields": "false"}))


def canonical_payload(fields: Column) -> Column:
    """JSON object text of a string map with its keys in sorted order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))
