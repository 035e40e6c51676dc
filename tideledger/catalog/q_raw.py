"""Raw index rows built from the book, with planted faults, and what decoding makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.catalog import binding as b
from tideledger.catalog import sqlbook as q
from tideledger.catalog.common import longs, query
from tideledger.functions.keys import canonical_payload
from tideledger.operators import evidence
from tideledger.operators.checks import exploded
from tideledger.schema import ABI_EVENTS, PROVENANCE_TUPLES
from tideledger.sources import raw_logs

# Which fault an event carries: the remainder of its place.
PLACE = "(block_number * 8 + log_index) % 61"
FAULTS = {
    "account": 1, "market": 2, "side": 3, "kind": 4, "abi": 5, "schema": 6, "id": 7, "parent": 8, "wire": 9,
    "negative": 10, "fraction": 11, "missing": 12,
}
#: Versions follow the account; events of a whole market need the newest ones.
VERSION = "case when kind in ('mark_updated', 'funding_scale_updated') or account_id is null then 2 else account_id % 3 end"


def fault(name: str) -> Column:
    return F.expr(PLACE) == FAULTS[name]


def _payload(abi: str) -> Column:
    """The payload of an event as a string map; a number that the book does not hold is 0."""
    _, account, has_market, has_side, fields = ABI_EVENTS[abi]
    entries = []
    if account is not None:
        entries += [(account, F.col("account_id"))]
    if has_market:
        entries += [("perpId", F.col("perpetual_id"))]
    if has_side:
        entries += [("positionType", F.col("position_type") - 1)]
    for field, column in fields.items():
        value = F.col(column)
        if column not in ("owner", "funding_allow_overwrite"):
            value = F.coalesce(value.cast("long"), F.lit(0))
        if abi == "MakerOrderFilled" and field == "pricePNS":
            value = F.when(fault("negative"), -value).otherwise(value)
        if abi == "MakerOrderFilled" and field == "lotLNS":
            value = F.when(fault("fraction"), F.concat(value.cast("string"), F.lit(".5"))).otherwise(value.cast("string"))
        if abi == "MakerOrderFilled" and field == "feeCNS":
            value = F.when(~fault("missing"), value)
        entries += [(field, value)]
    return F.create_map(*[x for name, value in entries for x in (F.lit(name), value.cast("string"))])


def raw_rows(spark, sf) -> DataFrame:
    """Every event of the book as an index row."""
    payload = None
    for kind, abi in b.ABI_OF_KIND.items():
        arm = F.col("kind") == kind
        payload = F.when(arm, _payload(abi)) if payload is None else payload.when(arm, _payload(abi))
    payload = F.map_filter(payload, lambda _, v: v.isNotNull())
    events = b.book(spark, sf).withColumn("v", F.expr(VERSION))
    versions = [F.element_at(F.array(*[F.lit(t[i]) for t in PROVENANCE_TUPLES]), F.col("v").cast("int") + 1) for i in range(5)]
    side = F.col("position_type") - 1
    return events.select(
        F.when(fault("id"), "other").otherwise(F.col("event_id")).alias("id"), F.col("chain_id").alias("chainId"),
        F.col("block_number").alias("blockNumber"), F.col("block_hash").alias("blockHash"),
        F.when(fault("parent"), " ").otherwise("0xparent").alias("parentHash"), F.col("tx_hash").alias("txHash"),
        F.col("log_index").alias("logIndex"), F.col("timestamp_ms").alias("timestampMs"), F.col("contract_address").alias("srcAddress"),
        F.when(fault("abi"), "Unlisted").otherwise(F.col("abi_event_name")).alias("abiEventName"),
        F.when(fault("kind"), "OTHER").otherwise(F.upper("kind")).alias("kind"),
        F.when(fault("account"), F.col("account_id") + 1).otherwise(F.col("account_id")).alias("accountId"),
        F.when(fault("market"), F.col("perpetual_id") + 1).otherwise(F.col("perpetual_id")).alias("perpetualId"),
        F.when(fault("side"), 1 - side).when(fault("wire"), side + 2).otherwise(side).alias("positionType"),
        F.to_json(payload).alias("payloadJson"),
        F.when(fault("schema"), "unlisted").otherwise(versions[0]).alias("schemaVersion"), versions[1].alias("handlerVersion"),
        versions[2].alias("classifierVersion"), versions[3].alias("ingestionProfile"), versions[4].alias("abiFingerprint"),
    )


# Fixed facts of the rule table, for the SQL side.
_RULES = q.values([(k, a, ABI_EVENTS[a][1] is not None, ABI_EVENTS[a][2], ABI_EVENTS[a][3]) for k, a in b.ABI_OF_KIND.items()], ["kind", "abi", "has_account", "has_market", "has_side"])
_F = FAULTS
RAW_SQL = f"""rw AS (SELECT k.*, r.has_account, r.has_market, r.has_side, {PLACE} AS fault, {VERSION} AS v FROM book k JOIN {_RULES} r USING (kind)),
bad AS (SELECT event_id, kind, CASE WHEN fault={_F['id']} THEN 'other' ELSE event_id END AS id, violation FROM (
  SELECT *, 'account_differs' AS violation FROM rw WHERE fault IN ({_F['account']},{_F['abi']}) AND account_id IS NOT NULL
  UNION ALL SELECT *, 'perpetualId_differs' FROM rw WHERE fault IN ({_F['market']},{_F['abi']}) AND perpetual_id IS NOT NULL
  UNION ALL SELECT *, 'positionType_differs' FROM rw WHERE fault IN ({_F['side']},{_F['wire']},{_F['abi']}) AND position_type IS NOT NULL
  UNION ALL SELECT *, 'unsupported_side' FROM rw WHERE fault={_F['wire']} AND position_type IS NOT NULL
  UNION ALL SELECT *, 'kind_differs' FROM rw WHERE fault={_F['kind']}
  UNION ALL SELECT *, 'unknown_abi_event' FROM rw WHERE fault={_F['abi']}
  UNION ALL SELECT *, 'unknown_version_tuple' FROM rw WHERE fault={_F['schema']}
  UNION ALL SELECT *, 'market_event_version' FROM rw WHERE fault={_F['schema']} AND kind IN ('mark_updated','funding_scale_updated')
  UNION ALL SELECT *, 'id_differs' FROM rw WHERE fault={_F['id']}
  UNION ALL SELECT *, 'blank_provenance' FROM rw WHERE fault={_F['parent']}
  UNION ALL SELECT *, 'payload_field_negative' FROM rw WHERE fault={_F['negative']} AND kind='maker_fill'
  UNION ALL SELECT *, 'payload_field_invalid' FROM rw WHERE fault IN ({_F['fraction']},{_F['missing']}) AND kind='maker_fill'))"""
GOOD = "event_id NOT IN (SELECT event_id FROM bad)"


def decoded(spark, sf) -> tuple[DataFrame, DataFrame]:
    return raw_logs.project_raw_logs(raw_rows(spark, sf))


def violations(spark, sf) -> DataFrame:
    return decoded(spark, sf)[1].select("id", F.explode("violations").alias("violation"))


_ZERO = ["price_pns", "lot_lns", "fee_cns", "amount_cns", "delta_pnl_cns", "funding_sum_pns"]


@query(
    "S3_project_raw_logs",
    q.with_book(RAW_SQL) + "SELECT event_id, kind, account_id, CAST(perpetual_id AS BIGINT) AS perpetual_id, CAST(position_type AS BIGINT) AS position_type, "
    + ", ".join(f"CAST(COALESCE({c},0) AS BIGINT) AS {c}" for c in _ZERO) + f" FROM rw WHERE {GOOD}",
)
def project(spark, sf):
    """The events that decoding brings back; rows with a planted fault are set aside."""
    good, _ = decoded(spark, sf)
    return good.select("event_id", "kind", "account_id", *longs("perpetual_id", "position_type"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in _ZERO])


@query("S3_violations", q.with_book(RAW_SQL) + "SELECT id, violation FROM bad")
def all_violations(spark, sf):
    return violations(spark, sf)


@query("F2_classify_events", q.with_book(RAW_SQL) + f"SELECT CASE WHEN fault={_F['abi']} THEN 'Unlisted' ELSE abi_event_name END AS abi_event_name, CASE WHEN fault<>{_F['abi']} THEN kind END AS kind, count(*) AS events FROM rw GROUP BY 1,2")
def classify(spark, sf):
    """ABI events by the kind they stand for; an unlisted one has none."""
    rows = raw_logs.classify(raw_rows(spark, sf).select("abiEventName"))
    return rows.groupBy(F.col("abiEventName").alias("abi_event_name"), F.col("rule_kind").alias("kind")).agg(F.count(F.lit(1)).alias("events"))


@query("F4_verify_subjects", q.with_book(RAW_SQL) + "SELECT id, violation FROM bad WHERE violation IN ('account_differs','perpetualId_differs','positionType_differs')")
def subjects(spark, sf):
    return exploded(raw_logs.parsed_rows(raw_rows(spark, sf)), ["id"], raw_logs.subject_rules())


@query("F5_verify_provenance", q.with_book(RAW_SQL) + "SELECT id, violation FROM bad WHERE violation IN ('unknown_version_tuple','market_event_version','id_differs','blank_provenance')")
def provenance(spark, sf):
    return exploded(raw_logs.parsed_rows(raw_rows(spark, sf)), ["id"], raw_logs.provenance_rules())


@query("F6_map_wire_side", q.with_book(RAW_SQL) + f"SELECT kind, CAST(position_type-1 AS BIGINT) AS wire_side, CAST(position_type AS BIGINT) AS side, count(*) AS events FROM rw WHERE position_type IS NOT NULL AND {GOOD} GROUP BY 1,2,3")
def wire_sides(spark, sf):
    """Sides on the wire next to the sides of the ledger."""
    good, _ = decoded(spark, sf)
    wire = F.get_json_object("provenance.payload_json", "$.positionType").cast("long")
    rows = good.where("position_type is not null").groupBy("kind", wire.alias("wire_side"), F.col("position_type").cast("long").alias("side"))
    return rows.agg(F.count(F.lit(1)).alias("events"))


@query(
    "A13_provenance_profile",
    q.with_book(RAW_SQL, f"pt AS {q.values([(i, *t) for i, t in enumerate(PROVENANCE_TUPLES)], ['v', *evidence.PROFILE])}")
    + f"SELECT {', '.join(evidence.PROFILE)}, count(*) AS events FROM rw JOIN pt USING (v) WHERE {GOOD} AND block_number<={b.CUT.block_number} GROUP BY ALL",
)
def provenance_profile(spark, sf):
    return evidence.provenance_profile(decoded(spark, sf)[0], b.CUT)


@query(
    "M14_canonical_payload",
    q.with_book(RAW_SQL) + f"""SELECT event_id, '{{"accountId":"'||account_id||'","amountCNS":"0","balanceCNS":"0",'||CASE WHEN fault={_F['missing']} THEN '' ELSE '"feeCNS":"'||CAST(fee_cns AS BIGINT)||'",' END
 ||'"lotLNS":"'||CAST(lot_lns AS BIGINT)||CASE WHEN fault={_F['fraction']} THEN '.5' ELSE '' END||'","perpId":"'||perpetual_id||'","pricePNS":"'||CAST(CASE WHEN fault={_F['negative']} THEN -price_pns ELSE price_pns END AS BIGINT)||'"}}' AS payload
FROM rw WHERE kind='maker_fill' AND fault<>{_F['abi']}""",
)
def canonical_payloads(spark, sf):
    """Payloads of fills with their keys in order, whatever order they came in."""
    rows = raw_rows(spark, sf).where("abiEventName = 'MakerOrderFilled'")
    key = F.concat_ws(":", F.col("chainId").cast("string"), "blockHash", "txHash", F.col("logIndex").cast("string"))
    return rows.select(key.alias("event_id"), canonical_payload(F.from_json("payloadJson", raw_logs.MAP)).alias("payload"))


OBSERVED_AT = b.CUT.timestamp_ms - 3_600_000


def observed(spark, sf) -> DataFrame:
    """Metadata of the markets that trade, as someone else saw it: one scale differs, one margin, one new name."""
    seen = b.tape(spark, sf).where("kind = 'maker_fill'").select("perpetual_id").distinct()
    rows = seen.join(b.TAPE_REGISTRY.frame(spark), "perpetual_id")
    pid = F.col("perpetual_id")
    return rows.select(
        F.when(pid == 9, 11).otherwise(pid).cast("int").alias("perpetual_id"), F.concat(F.lit(" "), "symbol").alias("symbol"),
        F.when(pid == 2, F.col("price_decimals") + 1).otherwise(F.col("price_decimals")).cast("int").alias("price_decimals"), "size_decimals",
        "init_margin_frac_hdths", F.when(pid == 4, F.lit(5000)).otherwise(F.col("maint_margin_frac_hdths")).cast("int").alias("maint_margin_frac_hdths"),
    )


SEEN_SQL = """seen AS (SELECT CASE WHEN perpetual_id=9 THEN 11 ELSE perpetual_id END AS perpetual_id, symbol, price_decimals+CASE WHEN perpetual_id=2 THEN 1 ELSE 0 END AS price_decimals, size_decimals, init_margin_frac_hdths,
  CASE WHEN perpetual_id=4 THEN 5000 ELSE maint_margin_frac_hdths END AS maint_margin_frac_hdths FROM mk WHERE perpetual_id IN (SELECT perpetual_id FROM tape WHERE kind='maker_fill'))"""


@query(
    "E6_context_observation",
    q.with_tape(SEEN_SQL) + """SELECT CAST(COALESCE(s.perpetual_id,m.perpetual_id) AS BIGINT) AS perpetual_id, s.symbol, CASE WHEN s.perpetual_id IS NOT NULL THEN true END AS stale,
 'sha256:'||sha256('{"perpetual_id":'||s.perpetual_id||',"symbol":"'||s.symbol||'","price_decimals":'||s.price_decimals||',"size_decimals":'||s.size_decimals||',"init_margin_frac_hdths":'||s.init_margin_frac_hdths||',"maint_margin_frac_hdths":'||s.maint_margin_frac_hdths||'}') AS row_hash,
 CASE WHEN m.perpetual_id IS NULL THEN 'new' WHEN s.perpetual_id IS NULL THEN 'absent' WHEN s.perpetual_id IN (2,4) THEN 'changed' ELSE 'same' END AS change FROM seen s FULL JOIN mk m USING (perpetual_id)""",
)
def context_observation(spark, sf):
    """Observed metadata next to the registry: row hashes, age and what changed."""
    rows = observed(spark, sf)
    context = evidence.observed_context(rows, OBSERVED_AT, b.CUT, 60_000)
    change = evidence.registry_diff(b.TAPE_REGISTRY.frame(spark), rows.withColumn("symbol", F.trim("symbol")))
    joined = change.join(context.select("perpetual_id", "symbol", "stale", "row_hash"), "perpetual_id", "left")
    return joined.select(*longs("perpetual_id"), "symbol", "stale", "row_hash", "change")
