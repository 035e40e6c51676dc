"""The ten-day cohort of seven accounts on three markets: finished event rows, read from data/cohort.json."""

import json
from decimal import Decimal
from pathlib import Path

import kit
from pyspark.sql import functions as F

DEPLOYED, BLOCK_MS, DAY = kit.DEPLOYED, 400, 86_400_000
T0 = 1_770_000_000_000
ROWS = [dict(r, chain_id=kit.CHAIN, contract_address=kit.EXCHANGE) for r in json.loads((Path(__file__).parent / "data/cohort.json").read_text())]


def block_at(ms):
    return DEPLOYED + (ms - T0) // BLOCK_MS


def events(spark):
    return kit.frame(spark, [{k: Decimal(v) if isinstance(v, int) and k.endswith(("_cns", "_pns", "_lns")) else v for k, v in r.items()} for r in ROWS])


def scaled(spark, groups):
    """The account events once for each of some groups of accounts; market events stay single."""
    rows = events(spark)
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    own = rows.where("account_id is not null").select("*", group).withColumns(
        {
            "account_id": F.expr("account_id + 1000 * group"),
            "log_index": F.expr("cast(log_index + 16 + 16 * group as int)"),
            "tx_hash": F.expr("concat_ws('-', tx_hash, group)"),
        }
    )
    return own.drop("group").unionByName(rows.where("account_id is null"))
