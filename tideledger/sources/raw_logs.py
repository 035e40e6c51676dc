"""Bulk decoding of raw log rows into canonical events, without per-row Python.

The payload becomes one string map; each canonical column is a CASE over the
ABI names that carry it.  Broken rows are returned as violations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideledger.functions.keys import event_key
from tideledger.operators.checks import ADDRESS, event_rules, quarantine
from tideledger.params import local_frame
from tideledger.schema import ABI_EVENTS, EVENT, MARKET_SCHEMA_VERSION, PROVENANCE_TUPLES, SIGNED_PAYLOAD

RAW_SCHEMA = (
    "id string, chainId long, blockNumber long, blockHash string, parentHash string, txHash string, logIndex int,"
    " timestampMs long, srcAddress string, abiEventName string, kind string, accountId long, perpetualId int,"
    " positionType int, payloadJson string, schemaVersion string, handlerVersion string, classifierVersion string,"
    " ingestionProfile string, abiFingerprint string"
)
MAP = T.MapType(T.StringType(), T.StringType())


def rule_frame(spark) -> DataFrame:
    """Constant table: ABI event, kind and which subjects its payload names."""
    rows = [
        dict(abiEventName=n, rule_kind=r[0], account_field=r[1], has_market=r[2], has_side=r[3]) for n, r in ABI_EVENTS.items()
    ]
    types = [("abiEventName", pa.string()), ("rule_kind", pa.string()), ("account_field", pa.string()),
             ("has_market", pa.bool_()), ("has_side", pa.bool_())]
    return local_frame(spark, rows, pa.schema(types))


def classify(raw: DataFrame) -> DataFrame:
    """Join the rule table; an unknown ABI name keeps a null ``rule_kind``."""
    return raw.join(F.broadcast(rule_frame(raw.sparkSession)), "abiEventName", "left")


def parsed_rows(raw: DataFrame) -> DataFrame:
    """Raw rows with their rule and the payload as a map (null where it is no object).

    The generator keeps the many rules that read the map from parsing the text anew each.
    """
    return classify(raw).withColumn("payload", F.explode(F.array(F.from_json("payloadJson", MAP))))


def _column_sources() -> dict[str, dict[str, list[str]]]:
    """canonical column -> payload field -> ABI names that carry it there."""
    found: dict[str, dict[str, list[str]]] = {}
    for name, (_, _, _, _, fields) in ABI_EVENTS.items():
        for payload_field, column in fields.items():
            found.setdefault(column, {}).setdefault(payload_field, []).append(name)
    return found


def _payload_value(column: str, kind: str) -> Column:
    value = None
    for field, names in _column_sources()[column].items():
        text = F.col("payload")[field]
        arm = F.col("abiEventName").isin(names)
        value = F.when(arm, text) if value is None else value.when(arm, text)
    return value.try_cast(kind)


def subject_rules() -> dict[str, Column]:
    """Subject columns must equal the payload, and be absent where it has none."""
    p = F.col("payload")
    account = p[F.col("account_field")].try_cast("long")
    has_account = F.col("account_field").isNotNull()
    rules = {"account_differs": F.when(has_account, ~(account.eqNullSafe(F.col("accountId")) & account.isNotNull())).otherwise(F.col("accountId").isNotNull())}
    for flag, column, field in [("has_market", "perpetualId", "perpId"), ("has_side", "positionType", "positionType")]:
        value = p[field].try_cast("int")
        same = value.eqNullSafe(F.col(column)) & value.isNotNull()
        rules[f"{column}_differs"] = F.when(F.col(flag), ~same).otherwise(F.col(column).isNotNull())
    return rules


def provenance_rules() -> dict[str, Column]:
    columns = ["schemaVersion", "handlerVersion", "classifierVersion", "ingestionProfile", "abiFingerprint"]
    known = F.lit(False)
    for versions in PROVENANCE_TUPLES:
        match = F.lit(True)
        for column, value in zip(columns, versions):
            match = match & F.col(column).eqNullSafe(value)
        known = known | match
    blank = F.lit(False)
    for column in ["parentHash", *columns]:
        blank = blank | F.col(column).isNull() | (F.trim(column) == "")
    key = event_key("chainId", "blockHash", "txHash", "logIndex")
    market_event = F.col("abiEventName").isin("MarkUpdated", "FundingSumScalingExpUpdated")
    return {
        "id_differs": ~F.col("id").eqNullSafe(key),
        "blank_provenance": blank,
        "payload_not_object": F.col("payload").isNull(),
        "unknown_version_tuple": ~known,
        "market_event_version": market_event & ~F.col("schemaVersion").eqNullSafe(MARKET_SCHEMA_VERSION),
    }


def payload_rules() -> dict[str, Column]:
    """Every field an ABI event carries must be present, whole and in sign."""
    missing = negative = F.lit(False)
    for column, fields in _column_sources().items():
        for field, names in fields.items():
            here = F.col("abiEventName").isin(names)
            if column in ("owner", "funding_allow_overwrite"):
                ok = F.col("payload")[field].rlike(ADDRESS if column == "owner" else "^(true|false)$")
                missing = missing | (here & ~F.coalesce(ok, F.lit(False)))
            else:
                value = F.col("payload")[field].try_cast("decimal(38,0)")
                whole = F.coalesce(F.col("payload")[field].rlike(r"^-?\d+$"), F.lit(False))
                missing = missing | (here & (value.isNull() | ~whole))
                if field not in SIGNED_PAYLOAD and not (field == "amountCNS" and "MakerOrderFilled" in names):
                    negative = negative | (here & F.coalesce(value < 0, F.lit(False)))
    return {"payload_field_invalid": missing, "payload_field_negative": negative}


def project_raw_logs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical events, violations). Wire sides 0 and 1 become long and short."""
    parsed = parsed_rows(raw)
    rules = {
        "unknown_abi_event": F.col("rule_kind").isNull(),
        "kind_differs": F.upper("rule_kind") != F.col("kind"),
        "unsupported_side": F.col("positionType").isNotNull() & ~F.col("positionType").isin(0, 1),
        **provenance_rules(),
        **subject_rules(),
        **payload_rules(),
    }
    good, bad = quarantine(parsed, rules)
    identity = {
        "chain_id": "chainId", "block_number": "blockNumber", "log_index": "logIndex", "block_hash": "blockHash",
        "tx_hash": "txHash", "timestamp_ms": "timestampMs", "contract_address": "srcAddress",
        "abi_event_name": "abiEventName", "account_id": "accountId", "perpetual_id": "perpetualId",
    }
    sources = _column_sources()
    columns = []
    for f in EVENT.fields:
        if f.name in identity:
            value = F.col(identity[f.name])
        elif f.name == "kind":
            value = F.col("rule_kind")
        elif f.name == "position_type":
            value = F.col("positionType") + 1
        elif f.name == "provenance":
            value = F.struct(
                F.col("id").alias("envelope_id"), F.col("parentHash").alias("parent_hash"), F.col("payloadJson").alias("payload_json"),
                F.col("schemaVersion").alias("schema_version"), F.col("handlerVersion").alias("handler_version"),
                F.col("classifierVersion").alias("classifier_version"), F.col("ingestionProfile").alias("ingestion_profile"),
                F.col("abiFingerprint").alias("abi_fingerprint"),
            )
        elif f.name in sources:
            value = _payload_value(f.name, f.dataType.simpleString())
        else:
            value = F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    events = good.select("id", *columns).withColumn("event_id", F.col("id")).drop("id")
    clean, broken = quarantine(events, event_rules(events))
    violations = bad.select("id", "violations").unionByName(broken.select(F.col("event_id").alias("id"), "violations"))
    return clean, violations
