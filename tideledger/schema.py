"""Canonical event model: types, event kinds, ABI names and required fields."""

from __future__ import annotations

from pyspark.sql import types as T

from tideledger.functions.exact import DEC

LONG, SHORT = 1, 2

# Native integer payload columns, all decimal(38,0).
AMOUNT_COLUMNS = [
    "lot_lns", "start_lot_lns", "end_lot_lns", "liq_lot_lns", "price_pns", "mark_price_pns",
    "liq_price_pns", "amount_cns", "balance_cns", "start_balance_cns", "deposit_cns",
    "start_deposit_cns", "end_deposit_cns", "delta_pnl_cns", "funding_cns", "ins_fee_cns",
    "prot_fee_cns", "fee_cns", "funding_rate_pct100k", "funding_price_pns",
    "funding_payment_pns", "funding_sum_pns", "position_fmv_cns", "payment_cns",
    "amount_owed_cns",
]

PROVENANCE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in [
            "envelope_id", "parent_hash", "payload_json", "schema_version", "handler_version",
            "classifier_version", "ingestion_profile", "abi_fingerprint",
        ]
    ]
)

EVENT = T.StructType(
    [
        T.StructField("chain_id", T.LongType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("log_index", T.IntegerType()),
        T.StructField("block_hash", T.StringType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("contract_address", T.StringType()),
        T.StructField("abi_event_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("perpetual_id", T.IntegerType()),
        T.StructField("position_type", T.IntegerType()),
        T.StructField("owner", T.StringType()),
        T.StructField("leverage_hdths", T.IntegerType()),
        T.StructField("price_residue_pnsq16", T.IntegerType()),
        T.StructField("funding_event_block", T.LongType()),
        T.StructField("funding_allow_overwrite", T.BooleanType()),
        T.StructField("funding_scaling_exp", T.IntegerType()),
        *[T.StructField(name, DEC) for name in AMOUNT_COLUMNS],
        T.StructField("provenance", PROVENANCE),
    ]
)

MARK = T.StructType(
    [
        T.StructField("perpetual_id", T.IntegerType()),
        T.StructField("mark_pns", DEC),
        T.StructField("oracle_pns", DEC),
        T.StructField("block_number", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("log_index", T.IntegerType()),
        T.StructField("block_hash", T.StringType()),
    ]
)

# The fields each event kind must carry.
REQUIRED_FIELDS = {
    "account_created": ["account_id", "owner"],
    "account_liquidation_credit": ["account_id", "perpetual_id", "start_balance_cns", "balance_cns"],
    "account_to_protocol_transfer": ["account_id", "amount_cns", "balance_cns"],
    "protocol_to_account_transfer": ["account_id", "amount_cns", "balance_cns"],
    "collateral_deposit": ["account_id", "amount_cns", "balance_cns"],
    "collateral_withdrawal": ["account_id", "amount_cns", "balance_cns"],
    "position_opened": ["account_id", "perpetual_id", "position_type", "price_pns", "lot_lns", "deposit_cns"],
    "position_increased": [
        "account_id", "perpetual_id", "position_type", "price_pns", "start_lot_lns", "end_lot_lns",
        "start_deposit_cns", "end_deposit_cns",
    ],
    "position_decreased": [
        "account_id", "perpetual_id", "position_type", "start_lot_lns", "end_lot_lns",
        "start_deposit_cns", "end_deposit_cns", "delta_pnl_cns", "funding_cns",
    ],
    "position_closed": ["account_id", "perpetual_id", "position_type", "price_pns", "delta_pnl_cns", "funding_cns"],
    "position_liquidated": [
        "account_id", "perpetual_id", "position_type", "liq_price_pns", "liq_lot_lns", "end_lot_lns",
        "deposit_cns", "delta_pnl_cns", "funding_cns",
    ],
    "position_liquidation_credit": ["account_id", "perpetual_id", "start_deposit_cns", "end_deposit_cns"],
    "position_deleveraged": [
        "account_id", "perpetual_id", "position_type", "start_lot_lns", "end_lot_lns",
        "start_deposit_cns", "end_deposit_cns", "delta_pnl_cns", "funding_cns",
    ],
    "position_inverted": [
        "account_id", "perpetual_id", "position_type", "price_pns", "start_lot_lns", "end_lot_lns",
        "start_deposit_cns", "end_deposit_cns", "delta_pnl_cns", "funding_cns",
    ],
    "position_unwound": ["account_id", "perpetual_id", "position_type", "price_pns", "lot_lns", "deposit_cns"],
    "collateral_increased": ["account_id", "perpetual_id", "deposit_cns", "amount_cns"],
    "collateral_decreased": ["account_id", "perpetual_id", "start_deposit_cns", "end_deposit_cns"],
    "market_funding": ["perpetual_id", "funding_rate_pct100k"],
    "mark_updated": ["perpetual_id", "mark_price_pns"],
    "funding_scale_updated": ["perpetual_id", "funding_scaling_exp"],
    "maker_fill": ["account_id", "perpetual_id", "price_pns", "lot_lns", "fee_cns"],
    "taker_fill": ["price_pns", "lot_lns", "fee_cns"],
    "order_request": ["account_id", "perpetual_id"],
    "contract_added": ["perpetual_id"],
}
KINDS = list(REQUIRED_FIELDS)

# Kinds that read or change a position.
POSITION_KINDS = [
    "position_opened", "position_increased", "position_decreased", "position_closed",
    "position_liquidated", "position_liquidation_credit", "position_deleveraged",
    "position_inverted", "position_unwound", "collateral_increased", "collateral_decreased",
]

# Kinds that make an account count as active.
TRADING_KINDS = ["maker_fill", *POSITION_KINDS]
FUNDING_KINDS = ["market_funding", "funding_scale_updated"]
RESET_KINDS = ["position_opened", "position_increased", "position_inverted"]
SETTLE_KINDS = ["position_decreased", "position_liquidated", "position_deleveraged"]

# ABI event -> kind, payload field of the account, whether the
# payload names a market and a position side, and payload field -> column.
ABI_EVENTS = {
    "AccountCreated": ("account_created", "id", False, False, {"account": "owner"}),
    "AccountLiquidationCredit": ("account_liquidation_credit", "accountId", True, False, {
        "startBalanceCNS": "start_balance_cns", "endBalanceCNS": "balance_cns",
    }),
    "TransferAccountToProtocol": ("account_to_protocol_transfer", "accountId", False, False, {
        "amountCNS": "amount_cns", "balanceCNS": "balance_cns",
    }),
    "TransferProtocolToAccount": ("protocol_to_account_transfer", "accountId", False, False, {
        "amountCNS": "amount_cns", "balanceCNS": "balance_cns",
    }),
    "CollateralDeposit": ("collateral_deposit", "accountId", False, False, {
        "amountCNS": "amount_cns", "balanceCNS": "balance_cns",
    }),
    "CollateralWithdrawal": ("collateral_withdrawal", "accountId", False, False, {
        "amountCNS": "amount_cns", "balanceCNS": "balance_cns",
    }),
    "IncreasePositionCollateral": ("collateral_increased", "accountId", True, False, {
        "positionDepositCNS": "deposit_cns", "amountCNS": "amount_cns", "balanceCNS": "balance_cns",
    }),
    "PositionCollateralDecreased": ("collateral_decreased", "accountId", True, True, {
        "markPricePNS": "mark_price_pns", "endEntryPricePNS": "price_pns",
        "startDepositCNS": "start_deposit_cns", "endDepositCNS": "end_deposit_cns",
        "balanceCNS": "balance_cns",
    }),
    "PositionLiquidationCredit": ("position_liquidation_credit", "accountId", True, False, {
        "startDepositCNS": "start_deposit_cns", "endDepositCNS": "end_deposit_cns",
    }),
    "PositionOpened": ("position_opened", "accountId", True, True, {
        "leverageHdths": "leverage_hdths", "depositCNS": "deposit_cns", "pricePNS": "price_pns",
        "lotLNS": "lot_lns", "insFeeCNS": "ins_fee_cns", "protFeeCNS": "prot_fee_cns",
    }),
    "PositionOpenedV2": ("position_opened", "accountId", True, True, {
        "leverageHdths": "leverage_hdths", "depositCNS": "deposit_cns", "pricePNS": "price_pns",
        "lotLNS": "lot_lns", "insFeeCNS": "ins_fee_cns", "protFeeCNS": "prot_fee_cns",
        "priceResiduePNSQ16": "price_residue_pnsq16",
    }),
    "PositionIncreased": ("position_increased", "accountId", True, True, {
        "leverageHdths": "leverage_hdths", "startDepositCNS": "start_deposit_cns",
        "endDepositCNS": "end_deposit_cns", "startLotLNS": "start_lot_lns", "endLotLNS": "end_lot_lns",
        "pricePNS": "price_pns", "insFeeCNS": "ins_fee_cns", "protFeeCNS": "prot_fee_cns",
    }),
    "PositionIncreasedV2": ("position_increased", "accountId", True, True, {
        "leverageHdths": "leverage_hdths", "startDepositCNS": "start_deposit_cns",
        "endDepositCNS": "end_deposit_cns", "startLotLNS": "start_lot_lns", "endLotLNS": "end_lot_lns",
        "pricePNS": "price_pns", "insFeeCNS": "ins_fee_cns", "protFeeCNS": "prot_fee_cns",
        "priceResiduePNSQ16": "price_residue_pnsq16",
    }),
    "PositionDecreased": ("position_decreased", "accountId", True, True, {
        "startDepositCNS": "start_deposit_cns", "endDepositCNS": "end_deposit_cns",
        "startLotLNS": "start_lot_lns", "endLotLNS": "end_lot_lns", "deltaPnlCNS": "delta_pnl_cns",
        "fundingCNS": "funding_cns",
    }),
    "PositionClosed": ("position_closed", "accountId", True, True, {
        "pricePNS": "price_pns", "deltaPnlCNS": "delta_pnl_cns", "fundingCNS": "funding_cns",
    }),
    "PositionLiquidated": ("position_liquidated", "posAccountId", True, True, {
        "markPricePNS": "mark_price_pns", "liqPricePNS": "liq_price_pns", "liqLotLNS": "liq_lot_lns",
        "posLotLNS": "end_lot_lns", "posDepositCNS": "deposit_cns", "deltaPnlCNS": "delta_pnl_cns",
        "fundingCNS": "funding_cns", "accBalanceCNS": "balance_cns",
    }),
    "PositionDeleveraged": ("position_deleveraged", "accountId", True, True, {
        "markPricePNS": "mark_price_pns", "deleveragePricePNS": "price_pns",
        "startDepositCNS": "start_deposit_cns", "endDepositCNS": "end_deposit_cns",
        "startLotLNS": "start_lot_lns", "endLotLNS": "end_lot_lns", "deltaPnlCNS": "delta_pnl_cns",
        "fundingCNS": "funding_cns", "balanceCNS": "balance_cns",
    }),
    "PositionDeleveragedV2": ("position_deleveraged", "accountId", True, True, {
        "markPricePNS": "mark_price_pns", "deleveragePricePNS": "price_pns",
        "startDepositCNS": "start_deposit_cns", "endDepositCNS": "end_deposit_cns",
        "startLotLNS": "start_lot_lns", "endLotLNS": "end_lot_lns", "deltaPnlCNS": "delta_pnl_cns",
        "fundingCNS": "funding_cns", "balanceCNS": "balance_cns",
    }),
    "PositionInverted": ("position_inverted", "accountId", True, True, {
        "leverageHdths": "leverage_hdths", "startDepositCNS": "start_deposit_cns",
        "endDepositCNS": "end_deposit_cns", "startLotLNS": "start_lot_lns", "endLotLNS": "end_lot_lns",
        "pricePNS": "price_pns", "deltaPnlCNS": "delta_pnl_cns", "fundingCNS": "funding_cns",
        "insFeeCNS": "ins_fee_cns", "protFeeCNS": "prot_fee_cns",
    }),
    "PositionUnwound": ("position_unwound", "accountId", True, True, {
        "markPricePNS": "mark_price_pns", "pricePNS": "price_pns", "lotLNS": "lot_lns",
        "depositCNS": "deposit_cns", "positionFmvCNS": "position_fmv_cns", "paymentCNS": "payment_cns",
        "balanceCNS": "balance_cns",
    }),
    "PositionUnwoundV2": ("position_unwound", "accountId", True, True, {
        "markPricePNS": "mark_price_pns", "pricePNS": "price_pns", "lotLNS": "lot_lns",
        "depositCNS": "deposit_cns", "positionFmvCNS": "position_fmv_cns", "paymentCNS": "payment_cns",
        "balanceCNS": "balance_cns",
    }),
    "PositionUnwoundWithoutPayment": ("position_unwound", "accountId", True, True, {
        "markPricePNS": "mark_price_pns", "pricePNS": "price_pns", "lotLNS": "lot_lns",
        "depositCNS": "deposit_cns", "positionFmvCNS": "position_fmv_cns", "amountOwedCNS": "amount_owed_cns",
    }),
    "PositionUnwoundWithoutPaymentV2": ("position_unwound", "accountId", True, True, {
        "markPricePNS": "mark_price_pns", "pricePNS": "price_pns", "lotLNS": "lot_lns",
        "depositCNS": "deposit_cns", "positionFmvCNS": "position_fmv_cns", "amountOwedCNS": "amount_owed_cns",
    }),
    "MarkUpdated": ("mark_updated", None, True, False, {"pricePNS": "mark_price_pns"}),
    "FundingSumScalingExpUpdated": ("funding_scale_updated", None, True, False, {"newExp": "funding_scaling_exp"}),
    "FundingEventCompleted": ("market_funding", None, True, False, {
        "actualRatePct100k": "funding_rate_pct100k", "fundingPricePNS": "funding_price_pns",
        "fundingPaymentPNS": "funding_payment_pns", "fundingSumPNS": "funding_sum_pns",
        "fundingEventBlock": "funding_event_block", "allowOverwrite": "funding_allow_overwrite",
    }),
    "MakerOrderFilled": ("maker_fill", "accountId", True, False, {
        "pricePNS": "price_pns", "lotLNS": "lot_lns", "feeCNS": "fee_cns", "amountCNS": "amount_cns",
        "balanceCNS": "balance_cns",
    }),
    "MakerOrderFilledV2": ("maker_fill", "accountId", True, False, {
        "pricePNS": "price_pns", "lotLNS": "lot_lns", "feeCNS": "fee_cns", "amountCNS": "amount_cns",
        "balanceCNS": "balance_cns",
    }),
    "ContractAdded": ("contract_added", None, True, False, {}),
    "ContractAddedV2": ("contract_added", None, True, False, {}),
}
# Payload numbers that may be negative; all others must be non-negative.
SIGNED_PAYLOAD = [
    "deltaPnlCNS", "fundingCNS", "positionFmvCNS", "actualRatePct100k", "fundingPaymentPNS", "fundingSumPNS",
]

# Accepted provenance tuples (schema, handler, classifier, profile, ABI fingerprint).
PROVENANCE_TUPLES = [
    (
        "canonical-event-v3", "envio-handlers-v3", "exchange-classifier-v2", "risk-hotpath-v1",
        "sha256:43f05c149262dbc7627530cb2e24d7ff56ff932c625b2e3fde4161558b86d267",
    ),
    (
        "canonical-event-v4", "envio-handlers-v4", "exchange-classifier-v3", "risk-hotpath-v2",
        "sha256:b98e14a49e4201d71feeae380261784fc8872aa45b201d193194c6c5d56adbf1",
    ),
    (
        "canonical-event-v5", "envio-handlers-v5", "exchange-classifier-v4", "risk-hotpath-v3",
        "sha256:8858f1c8a42836c58459ec37a89359deb015b23e0840c7f21efddf1c3b7315e6",
    ),
]
MARKET_SCHEMA_VERSION = "canonical-event-v5"
REPLAY_PROFILES = ["risk-hotpath-v2", "risk-hotpath-v3"]
#: The ingestion profile whose events include every market input.
MARKET_PROFILE = "risk-hotpath-v3"
