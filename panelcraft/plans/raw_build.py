"""Feature builds straight from the raw exports (the two parties' data-processing step).

``guest_from_raw`` / ``host_from_raw`` read the raw CSVs of one split
(``train`` or ``test``) under ``base/<split>/...``, build the quarterly
features with the same plans the driver queries use, and return them with
money converted back to currency units. ``write_split_features`` stores
them partitioned by split tag (S5) or as catalog tables (S7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.functions.scalar import parse_amount
from panelcraft.functions.scalar import year_of
from panelcraft.operators.impute import fill_global_mean
from panelcraft.plans.features import guest_features
from panelcraft.plans.features import host_features
from panelcraft.plans.panel import from_fixed
from panelcraft.plans.panel import to_money_fixed
from panelcraft.sources.io import register_table
from panelcraft.sources.io import write_features
from panelcraft.sources.raw import bill_month
from panelcraft.sources.raw import read_raw

# Spine ranges of the two parties, the quarter to predict, and file locations.
GUEST_SPINE = ("2017-01-01", "2021-12-01")
HOST_SPINE = ("2019-01-01", "2021-12-01")
TARGET = (2021, 4)
GUEST_FILES = {"payments": "government_data/zs_jks.csv", "filings": "government_data/sb_xssr.csv",
               "register": "government_data/sz_tmp_baseinfo_ent.csv"}
HOST_FILES = {"bills": "power_data/dlsj_df.csv", "accounts": "power_data/dlsj_jcxx.csv"}
GUEST_CATEGORIES = ["org", "authority", "status", "industry", "district", "founded_year"]
HOST_CATEGORIES = ["load_type", "user_class", "market_class", "shift", "usage_kind", "industry"]


def guest_from_raw(spark: SparkSession, base: str, split: str) -> DataFrame:
    pay = read_raw(spark, f"{base}/{split}/{GUEST_FILES['payments']}", "payments")
    fil = read_raw(spark, f"{base}/{split}/{GUEST_FILES['filings']}", "filings")
    reg = read_raw(spark, f"{base}/{split}/{GUEST_FILES['register']}", "register")
    payments = pay.select("id", "start", "end", to_money_fixed("amount").alias("amount"))
    filings = fil.select(
        "id",
        "date",
        to_money_fixed("month_amount").alias("month_amount"),
        to_money_fixed("year_amount").alias("year_amount"),
        "filing_kind",
        "correction_kind",
    )
    # P4 parse the capital text, A6 fill with the mean over all register rows, P3 founding year
    reg = reg.withColumns({"capital": parse_amount("capital_text"), "founded_year": year_of("founded")})
    reg = fill_global_mean(reg, ["capital"])
    out = guest_features(
        payments,
        filings,
        reg,
        lo=GUEST_SPINE[0],
        hi=GUEST_SPINE[1],
        target=TARGET,
        mask=split == "test",  # the target quarter's label is masked (then imputed) on test data only
        register_order=["_row_order"],  # A5 keep the first row per id in file order
        capital="capital",
        register_categories=GUEST_CATEGORIES,
        filing_aggs={
            "month_amount": ("mean", "month_amount"),
            "year_amount": ("mean", "year_amount"),
            "filing_kind": ("max", "filing_kind"),
            "correction_kind": ("max", "correction_kind"),
        },
        filled=["month_amount", "year_amount"],
        averaged=["month_amount"],
    )
    money = ["y", "month_amount", "year_amount", "y_avg", "year_y_avg", "month_amount_avg", "year_month_amount_avg"]
    return out.withColumns({c: from_fixed(c) for c in money})


def host_from_raw(spark: SparkSession, base: str, split: str, summed_codes: bool = False) -> DataFrame:
    bills = bill_month(read_raw(spark, f"{base}/{split}/{HOST_FILES['bills']}", "bills")).select(
        "id",
        "date",
        F.col("energy").alias("qty"),
        to_money_fixed("billed").alias("price"),
        to_money_fixed("paid").alias("net"),
        F.col("fee_class").alias("code_a"),
        F.col("usage_class").alias("code_b"),
    )
    acc = read_raw(spark, f"{base}/{split}/{HOST_FILES['accounts']}", "accounts")
    out = host_features(
        bills,
        acc,
        lo=HOST_SPINE[0],
        hi=HOST_SPINE[1],
        target=TARGET,
        register_order=["_row_order"],
        register_categories=HOST_CATEGORIES,
        summed_codes=summed_codes,
    )
    return out.withColumns({c: from_fixed(c) for c in ["price", "net", "price_avg"]})


def write_split_features(df: DataFrame, path: str | None = None, table: tuple[str, str] | None = None) -> None:
    """Store a feature table by split tag, or register it as ``namespace.name``."""
    if path:
        write_features(df, path, "split")
    if table:
        register_table(df, table[1], table[0], replace=True)
