"""S1 + S2 for the raw exports: header names, types and neutral short names.

Raw files carry more columns than are used, so they are read with
``header=True`` and every value as text (no schema inference); the named
columns are then selected, renamed and parsed with explicit types
(``try_*`` casts: a bad value becomes NULL instead of failing the job).
``_row_order`` records file order (``monotonically_increasing_id`` right
after the scan), which the keep-first de-duplication of registers uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.functions.scalar import parse_compact_month

# Raw column headers of the five exports (in file-header text) and the
# neutral names and types they are read as.
RAW_TABLES: dict[str, dict[str, tuple[str, str]]] = {
    "payments": {
        "公司ID": ("id", "bigint"),
        "税款所属期起": ("start", "date"),
        "税款所属期止": ("end", "date"),
        "实缴金额": ("amount", "double"),
    },
    "filings": {
        "公司ID": ("id", "bigint"),
        "本月数、本期数(按季申报)": ("month_amount", "double"),
        "本年累计": ("year_amount", "double"),
        "申报属性代码(11正常申报; 21自查补报)": ("filing_kind", "int"),
        "更正类型代码(1新产生申报表; 5更正后新产生的申报表)": ("correction_kind", "int"),
        "申报日期": ("date", "date"),
    },
    "register": {
        "公司ID": ("id", "bigint"),
        "组织": ("org", "string"),
        "批准设立机关": ("authority", "string"),
        "设立日期": ("founded", "date"),
        "注册资本金（万元）": ("capital_text", "string"),
        "行业类别": ("industry", "string"),
        "状态1,在营（开业）企业、2,吊销企业、3,注销企业、4,迁出，从地方提取。不是标准代码，根据地方实际情况增加的。EX02": ("status", "int"),
        "所属管区": ("district", "string"),
    },
    "bills": {
        "公司ID": ("id", "bigint"),
        "应收年月": ("month_text", "string"),
        "费用类别": ("fee_class", "int"),
        "能源量": ("energy", "double"),
        "应收金额": ("billed", "double"),
        "实收金额": ("paid", "double"),
        "用能类别": ("usage_class", "int"),
    },
    "accounts": {
        "公司ID": ("id", "bigint"),
        "负荷性质": ("load_type", "string"),
        "合同容量": ("contract_capacity", "double"),
        "用户分类": ("user_class", "string"),
        "承压": ("voltage", "double"),
        "市场化属性分类": ("market_class", "string"),
        "生产班次": ("shift", "string"),
        "用电类别": ("usage_kind", "string"),
        "运行容量": ("running_capacity", "double"),
        "所属行业": ("industry", "string"),
    },
}

# Date layouts accepted in raw date columns, tried in this order.
DATE_PATTERNS = ["yyyy-MM-dd", "yyyy/M/d", "yyyyMMdd", "yyyy-M-d"]


def parse_date(c: Column) -> Column:
    """Text date in any of DATE_PATTERNS (a time part after the date is ignored); NULL otherwise."""
    head = F.trim(F.split(F.trim(c), " ").getItem(0))
    return F.coalesce(*[F.try_to_date(head, p) for p in DATE_PATTERNS])


def typed(c: Column, kind: str) -> Column:
    if kind == "date":
        return parse_date(c)
    if kind == "string":
        return F.when(F.trim(c) != "", c)
    number = F.trim(c).try_cast(kind)
    if kind in ("int", "bigint"):  # text such as '11.0' also parses for whole numbers; whole text keeps all its digits
        return F.coalesce(number, F.trim(c).try_cast("double").try_cast(kind))
    return number


def read_raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read one raw export as typed neutral columns plus ``_row_order`` (file order)."""
    spec = RAW_TABLES[kind]
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    # partitions are filled largest file first, so ids alone are no file order
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    raw = raw.withColumn("_row_order", at)
    missing = [h for h in spec if h not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return raw.select(*[typed(F.col(f"`{h}`"), t).alias(n) for h, (n, t) in spec.items()], "_row_order")


def bill_month(df: DataFrame) -> DataFrame:
    """The 'yyyyMM' bill month as a month-start date."""
    return df.withColumn("date", parse_compact_month("month_text"))
