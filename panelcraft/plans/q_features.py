"""Feature-build queries: guest and host builds, register, aggregates, codes, splits, key joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.functions.scalar import parse_compact_month
from panelcraft.functions.scalar import parse_row_key
from panelcraft.functions.scalar import tag_split
from panelcraft.functions.scalar import to_fixed
from panelcraft.operators import spine as sp
from panelcraft.operators.encode import DictionaryEncoder
from panelcraft.operators.encode import factorize
from panelcraft.operators.encode import fit_one_hot
from panelcraft.operators.encode import one_hot
from panelcraft.operators.impute import overwrite_rows
from panelcraft.operators.impute import replace_zero_with_mean
from panelcraft.operators.rollup import first_row
from panelcraft.operators.rollup import multi_agg
from panelcraft.operators.split import period_split
from panelcraft.operators.split import stack
from panelcraft.plans.features import guest_features
from panelcraft.plans.features import host_features
from panelcraft.plans.features import host_panel
from panelcraft.plans.inputs import SPINE_HI
from panelcraft.plans.inputs import SPINE_LO
from panelcraft.plans.inputs import SQL_BILLS
from panelcraft.plans.inputs import SQL_FACTS
from panelcraft.plans.inputs import SQL_FILINGS
from panelcraft.plans.inputs import SQL_N
from panelcraft.plans.inputs import SQL_REGISTER_CTES
from panelcraft.plans.inputs import TARGET_QUARTER
from panelcraft.plans.inputs import TARGET_YEAR
from panelcraft.plans.inputs import T
from panelcraft.plans.inputs import bills
from panelcraft.plans.inputs import filings
from panelcraft.plans.inputs import payments
from panelcraft.plans.inputs import query
from panelcraft.plans.inputs import register
from panelcraft.plans.inputs import sql_months
from panelcraft.plans.panel import from_fixed
from panelcraft.plans.queries import SQL_QUARTERLY
from panelcraft.plans.queries import q_quarterly_panel

# Fixed values of the test mapping: host spine range, test entity segments,
# training period of the fitted dictionary, salt of the blinded key.
HOST_LO, HOST_HI = "1995-01-01", "2001-12-01"
TEST_SEGMENTS = ("AUTOMOBILE", "BUILDING")
DICT_TRAIN_BEFORE = "2000-01-01"
BLIND_SALT = "panel-salt-v1"


def _sql_dict(col: str, src: str = "k", order: str = "ord") -> str:
    return (
        f"d_{col} AS (SELECT {col} AS v, CAST(row_number() OVER (ORDER BY MIN({order})) - 1 AS INTEGER) AS code "
        f"FROM {src} GROUP BY {col})"
    )


def _sql_join_dict(col: str, src: str = "k") -> str:
    return f"JOIN d_{col} ON {src}.{col} IS NOT DISTINCT FROM d_{col}.v"


def _sql_sid(a: str = "") -> str:
    return f"CAST({a}id AS VARCHAR) || CAST({a}year AS VARCHAR) || lpad(CAST({a}quarter AS VARCHAR), 2, '0')"


# ------------------------------------------------------------------- guest
GUEST_CATS = ["year", "quarter", "prio", "status", "c_mktsegment", "c_nationkey"]
SQL_GUEST = f"""
WITH f AS ({SQL_FACTS}),
ids AS (SELECT DISTINCT id FROM f WHERE id IS NOT NULL),
v AS (SELECT id, ms, me, amt // {SQL_N} AS rate FROM f WHERE ms <= me),
e AS (SELECT id, rate, CAST(unnest(generate_series(ms, me, INTERVAL 1 MONTH)) AS DATE) AS month FROM v),
m AS (SELECT id, month, CAST(SUM(rate) AS BIGINT) AS y FROM e GROUP BY id, month),
fi AS ({SQL_FILINGS}),
fm AS (SELECT id, month, CAST(SUM(price) // COUNT(price) AS BIGINT) AS month_amount, MAX(prio) AS prio,
              MAX(status) AS status
       FROM fi WHERE id IS NOT NULL AND month IS NOT NULL GROUP BY id, month),
s AS (SELECT id, {sql_months(SPINE_LO, SPINE_HI)} AS month FROM ids),
p AS (SELECT s.id, CAST(year(s.month) AS INTEGER) AS year, CAST(quarter(s.month) AS INTEGER) AS quarter,
             CASE WHEN year(s.month) = {TARGET_YEAR} AND quarter(s.month) = {TARGET_QUARTER} THEN NULL ELSE m.y END AS y,
             fm.month_amount, fm.prio, fm.status
      FROM s LEFT JOIN m ON s.id = m.id AND s.month = m.month
             LEFT JOIN fm ON s.id = fm.id AND s.month = fm.month),
fl AS (SELECT id, year, quarter,
              COALESCE(y, CAST(SUM(y) OVER (PARTITION BY id) // COUNT(y) OVER (PARTITION BY id) AS BIGINT)) AS y,
              COALESCE(month_amount, CAST(SUM(month_amount) OVER (PARTITION BY id)
                                          // COUNT(month_amount) OVER (PARTITION BY id) AS BIGINT)) AS month_amount,
              prio, status
       FROM p),
q AS (SELECT id, year, quarter, CAST(COALESCE(SUM(y), 0) AS BIGINT) AS y,
             CAST(COALESCE(SUM(month_amount), 0) AS BIGINT) AS month_amount,
             COALESCE(SUM(prio), 0) AS prio, COALESCE(SUM(status), 0) AS status
      FROM fl GROUP BY id, year, quarter),
qm AS (SELECT *,
         CAST(SUM(y) OVER (PARTITION BY id, quarter) // COUNT(y) OVER (PARTITION BY id, quarter) AS BIGINT) AS y_avg,
         CAST(SUM(y) OVER (PARTITION BY id, year) // COUNT(y) OVER (PARTITION BY id, year) AS BIGINT) AS year_y_avg,
         CAST(SUM(month_amount) OVER (PARTITION BY id, quarter) // COUNT(month_amount) OVER (PARTITION BY id, quarter)
              AS BIGINT) AS month_amount_avg,
         CAST(SUM(month_amount) OVER (PARTITION BY id, year) // COUNT(month_amount) OVER (PARTITION BY id, year)
              AS BIGINT) AS year_month_amount_avg
       FROM q),
{SQL_REGISTER_CTES},
j AS (SELECT qm.*, reg.capital, reg.c_mktsegment, reg.c_nationkey FROM qm LEFT JOIN reg ON qm.id = reg.id),
z AS (SELECT * REPLACE (CASE WHEN capital = 0 THEN (SELECT CAST(SUM(capital) // COUNT(capital) AS BIGINT) FROM j)
                             ELSE capital END AS capital) FROM j),
k AS (SELECT *, id * 100000 + year * 10 + quarter AS ord FROM z),
{", ".join(_sql_dict(c) for c in GUEST_CATS)}
SELECT {_sql_sid("k.")} AS sid, k.id,
       {", ".join(f"d_{c}.code AS {c}" for c in GUEST_CATS)},
       k.y / 1e8 AS y, k.month_amount / 1e8 AS month_amount, k.y_avg / 1e8 AS y_avg, k.year_y_avg / 1e8 AS year_y_avg,
       k.month_amount_avg / 1e8 AS month_amount_avg, k.year_month_amount_avg / 1e8 AS year_month_amount_avg,
       k.capital / 1e2 AS capital,
       CASE WHEN k.year = {TARGET_YEAR} AND k.quarter = {TARGET_QUARTER} THEN 'predict' ELSE 'valid' END AS split
FROM k {" ".join(_sql_join_dict(c) for c in GUEST_CATS)}
"""


def guest_build(spark: SparkSession, d: str) -> DataFrame:
    reg = register(spark, d).select("id", "capital", "c_mktsegment", "c_nationkey", "c_name")
    return guest_features(
        payments(spark, d),
        filings(spark, d),
        reg,
        lo=SPINE_LO,
        hi=SPINE_HI,
        target=(TARGET_YEAR, TARGET_QUARTER),
        register_order=["c_name", "capital"],
        register_categories=["c_mktsegment", "c_nationkey"],
    )


@query("guest_features", SQL_GUEST)
def q_guest_features(spark: SparkSession, d: str) -> DataFrame:
    """Guest build end to end: payments + filings + register -> coded quarterly features with split tag."""
    g = guest_build(spark, d)
    money = ["y", "month_amount", "y_avg", "year_y_avg", "month_amount_avg", "year_month_amount_avg"]
    return g.select(
        "sid",
        "id",
        *GUEST_CATS,
        *[from_fixed(c).alias(c) for c in money],
        (F.col("capital") / F.lit(1e2)).alias("capital"),
        "split",
    )


# -------------------------------------------------------------------- host
HOST_CATS = ["year", "quarter", "code_a", "code_b", "c_mktsegment", "c_nationkey"]


def _sql_mode(src: str, keys: str, col: str) -> str:
    return (
        f"SELECT {keys}, {col} FROM (SELECT {keys}, {col}, row_number() OVER (PARTITION BY {keys} "
        f"ORDER BY COUNT(*) DESC, {col}) AS rn FROM {src} WHERE {col} IS NOT NULL GROUP BY {keys}, {col}) WHERE rn = 1"
    )


SQL_HOST_PANEL_CTES = f"""
b AS ({SQL_BILLS}),
ids AS (SELECT DISTINCT id FROM b WHERE id IS NOT NULL),
br AS (SELECT * FROM b WHERE id IS NOT NULL AND month >= DATE '{HOST_LO}' AND month <= DATE '{HOST_HI}'),
ms AS (SELECT id, month, SUM(qty) AS qty, SUM(price) AS price, SUM(net) AS net FROM br GROUP BY id, month),
ma AS ({_sql_mode("br", "id, month", "code_a")}),
mb AS ({_sql_mode("br", "id, month", "code_b")}),
s AS (SELECT id, {sql_months(HOST_LO, HOST_HI)} AS month FROM ids),
p AS (SELECT s.id, CAST(year(s.month) AS INTEGER) AS year, CAST(quarter(s.month) AS INTEGER) AS quarter,
             ms.qty, ms.price, ms.net, ma.code_a, mb.code_b
      FROM s LEFT JOIN ms ON s.id = ms.id AND s.month = ms.month
             LEFT JOIN ma ON s.id = ma.id AND s.month = ma.month
             LEFT JOIN mb ON s.id = mb.id AND s.month = mb.month),
fl AS (SELECT id, year, quarter,
              COALESCE(qty, CAST(SUM(qty) OVER (PARTITION BY id) // COUNT(qty) OVER (PARTITION BY id) AS BIGINT)) AS qty,
              COALESCE(price, CAST(SUM(price) OVER (PARTITION BY id) // COUNT(price) OVER (PARTITION BY id) AS BIGINT))
                AS price,
              net, code_a, code_b
       FROM p),
q0 AS (SELECT id, year, quarter, CAST(COALESCE(SUM(qty), 0) AS BIGINT) AS qty,
              CAST(COALESCE(SUM(price), 0) AS BIGINT) AS price, CAST(COALESCE(SUM(net), 0) AS BIGINT) AS net
       FROM fl GROUP BY id, year, quarter),
qa AS ({_sql_mode("fl", "id, year, quarter", "code_a")}),
qb AS ({_sql_mode("fl", "id, year, quarter", "code_b")}),
hq AS (SELECT q0.*, qa.code_a, qb.code_b,
          CAST(SUM(q0.price) OVER (PARTITION BY q0.id, q0.quarter) // COUNT(q0.price) OVER (PARTITION BY q0.id, q0.quarter)
               AS BIGINT) AS price_avg,
          CAST(SUM(q0.qty) OVER (PARTITION BY q0.id, q0.quarter) // COUNT(q0.qty) OVER (PARTITION BY q0.id, q0.quarter)
               AS BIGINT) AS qty_avg
       FROM q0 LEFT JOIN qa ON q0.id = qa.id AND q0.year = qa.year AND q0.quarter = qa.quarter
               LEFT JOIN qb ON q0.id = qb.id AND q0.year = qb.year AND q0.quarter = qb.quarter)
"""

SQL_HOST_PANEL = f"""
WITH {SQL_HOST_PANEL_CTES}
SELECT {_sql_sid()} AS sid, id, year, quarter, qty, price / 1e8 AS price, net / 1e8 AS net, code_a, code_b,
       price_avg / 1e8 AS price_avg, qty_avg
FROM hq
"""


@query("host_panel", SQL_HOST_PANEL)
def q_host_panel(spark: SparkSession, d: str) -> DataFrame:
    """Host quarterly panel from bills: monthly sums and modes (A3), spine, fill, roll-up, seasonal means."""
    h = host_panel(bills(spark, d), lo=HOST_LO, hi=HOST_HI)
    return h.select(
        "sid",
        "id",
        "year",
        "quarter",
        "qty",
        from_fixed("price").alias("price"),
        from_fixed("net").alias("net"),
        "code_a",
        "code_b",
        from_fixed("price_avg").alias("price_avg"),
        "qty_avg",
    )


SQL_HOST = f"""
WITH {SQL_HOST_PANEL_CTES},
{SQL_REGISTER_CTES},
j AS (SELECT hq.*, reg.c_mktsegment, reg.c_nationkey FROM hq LEFT JOIN reg ON hq.id = reg.id),
k AS (SELECT *, id * 100000 + year * 10 + quarter AS ord FROM j),
{", ".join(_sql_dict(c) for c in HOST_CATS)}
SELECT {_sql_sid("k.")} AS sid, k.id, {", ".join(f"d_{c}.code AS {c}" for c in HOST_CATS)},
       k.qty, k.price / 1e8 AS price, k.net / 1e8 AS net, k.price_avg / 1e8 AS price_avg, k.qty_avg,
       CASE WHEN k.year = {TARGET_YEAR} AND k.quarter = {TARGET_QUARTER} THEN 'predict' ELSE 'valid' END AS split
FROM k {" ".join(_sql_join_dict(c) for c in HOST_CATS)}
"""


def host_build(spark: SparkSession, d: str) -> DataFrame:
    reg = register(spark, d).select("id", "c_mktsegment", "c_nationkey")
    return host_features(
        bills(spark, d),
        reg,
        lo=HOST_LO,
        hi=HOST_HI,
        target=(TARGET_YEAR, TARGET_QUARTER),
        register_categories=["c_mktsegment", "c_nationkey"],
    )


@query("host_features", SQL_HOST)
def q_host_features(spark: SparkSession, d: str) -> DataFrame:
    """Host build end to end: bills + register -> coded quarterly features with split tag."""
    h = host_build(spark, d)
    return h.select(
        "sid",
        "id",
        *HOST_CATS,
        "qty",
        from_fixed("price").alias("price"),
        from_fixed("net").alias("net"),
        from_fixed("price_avg").alias("price_avg"),
        "qty_avg",
        "split",
    )


# ---------------------------------------------------------------- J8 / J9
SQL_INTERSECT = f"""
SELECT g.sid, g.y, g.y_avg, g.year_y_avg, h.qty, h.price, h.net, h.price_avg
FROM ({SQL_QUARTERLY}) g JOIN ({SQL_HOST_PANEL}) h ON g.sid = h.sid
"""


def _host_q(spark: SparkSession, d: str) -> DataFrame:
    return q_host_panel(spark, d).select("id", "year", "quarter", "qty", "price", "net", "price_avg")


@query("key_intersection", SQL_INTERSECT)
def q_key_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Guest quarterly panel x host quarterly panel on the row key (features first, then intersection)."""
    g = q_quarterly_panel(spark, d).select("sid", "id", "year", "quarter", "y", "y_avg", "year_y_avg")
    j = sp.key_intersection(g, _host_q(spark, d), ["id", "year", "quarter"])
    return j.select("sid", "y", "y_avg", "year_y_avg", "qty", "price", "net", "price_avg")


SQL_BLIND = f"""
SELECT sha256('{BLIND_SALT}' || g.sid) AS bkey, g.y, h.price
FROM ({SQL_QUARTERLY}) g JOIN ({SQL_HOST_PANEL}) h ON g.sid = h.sid
"""


@query("blinded_intersection", SQL_BLIND)
def q_blinded_intersection(spark: SparkSession, d: str) -> DataFrame:
    """The same intersection on a salted SHA-256 of the key; raw keys are not carried."""
    g = q_quarterly_panel(spark, d).select("sid", "y")
    h = q_host_panel(spark, d).select("sid", "price")
    return sp.blinded_intersection(g, h, "sid", BLIND_SALT).select("bkey", "y", "price")


# ------------------------------------------------------------ P4 A6 O6 O7
@query("register_capital", f"WITH {SQL_REGISTER_CTES} SELECT id, capital_text, capital / 1e2 AS capital FROM reg")
def q_register_capital(spark: SparkSession, d: str) -> DataFrame:
    """P4 + A6: capital text with a unit suffix parsed to a number; unparseable -> global mean."""
    r = register(spark, d)
    return r.select("id", "capital_text", (F.col("capital") / F.lit(1e2)).alias("capital"))


def _zero_capital(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        "c_nationkey",
        F.greatest(to_fixed("c_acctbal"), F.lit(0).cast("bigint")).alias("capital"),
        "c_mktsegment",
    )


SQL_ZERO = """
WITH c AS (SELECT c_custkey AS id, c_nationkey, greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0) AS capital,
                  c_mktsegment FROM customer),
mu AS (SELECT CAST(SUM(capital) // COUNT(capital) AS BIGINT) AS m FROM c)
"""


@query(
    "zero_capital_fix",
    SQL_ZERO + "SELECT id, c_nationkey, (CASE WHEN capital = 0 THEN (SELECT m FROM mu) ELSE capital END) / 1e2 AS capital, "
    "c_mktsegment FROM c",
)
def q_zero_capital_fix(spark: SparkSession, d: str) -> DataFrame:
    """Zero capital replaced by the mean capital (zeros included in the mean)."""
    r = replace_zero_with_mean(_zero_capital(spark, d), "capital")
    return r.withColumn("capital", F.col("capital") / F.lit(1e2))


@query(
    "zero_capital_overwrite",
    SQL_ZERO + "SELECT CASE WHEN capital = 0 THEN (SELECT m FROM mu) ELSE id END AS id, "
    "CASE WHEN capital = 0 THEN CAST((SELECT m FROM mu) AS INTEGER) ELSE c_nationkey END AS c_nationkey, "
    "(CASE WHEN capital = 0 THEN (SELECT m FROM mu) ELSE capital END) / 1e2 AS capital, c_mktsegment FROM c",
)
def q_zero_capital_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """O7 (parity flag): rows with zero capital get the mean in every numeric column."""
    r = overwrite_rows(_zero_capital(spark, d), "capital")
    return r.withColumn("capital", F.col("capital") / F.lit(1e2))


# ------------------------------------------------------------ A2 A3 A5 S4
@query(
    "filings_monthly",
    f"""SELECT id, month, CAST(SUM(price) // COUNT(price) AS BIGINT) / 1e8 AS month_amount, MAX(prio) AS prio_max,
               MAX(status) AS status_max, COUNT(prio) AS n_filings
        FROM ({SQL_FILINGS}) WHERE id IS NOT NULL AND month IS NOT NULL GROUP BY id, month""",
)
def q_filings_monthly(spark: SparkSession, d: str) -> DataFrame:
    """A2 + P1: filings per (id, month): mean amount, max codes, count."""
    f = filings(spark, d).withColumn("month", F.trunc(F.col("date").cast("date"), "MM"))
    g = multi_agg(
        f,
        ["id", "month"],
        {"month_amount": ("mean", "price"), "prio_max": ("max", "prio"), "status_max": ("max", "status"), "n_filings": ("count", "prio")},
    )
    return g.withColumn("month_amount", from_fixed("month_amount"))


@query(
    "bills_monthly",
    f"""WITH br AS (SELECT * FROM ({SQL_BILLS}) WHERE id IS NOT NULL AND month IS NOT NULL),
        ms AS (SELECT id, month, SUM(qty) AS qty, SUM(price) AS price, SUM(net) AS net FROM br GROUP BY id, month),
        ma AS ({_sql_mode("br", "id, month", "code_a")}),
        mb AS ({_sql_mode("br", "id, month", "code_b")})
        SELECT ms.id, ms.month, CAST(ms.qty AS BIGINT) AS qty, CAST(ms.price AS BIGINT) / 1e8 AS price,
               CAST(ms.net AS BIGINT) / 1e8 AS net, ma.code_a, mb.code_b
        FROM ms LEFT JOIN ma ON ms.id = ma.id AND ms.month = ma.month
                LEFT JOIN mb ON ms.id = mb.id AND ms.month = mb.month""",
)
def q_bills_monthly(spark: SparkSession, d: str) -> DataFrame:
    """A3: bills per (id, ship month): three sums and two modes (most frequent, ties -> smallest)."""
    b = bills(spark, d).withColumn("month", F.trunc(F.col("date").cast("date"), "MM"))
    g = multi_agg(
        b,
        ["id", "month"],
        {
            "qty": ("sum", "qty"),
            "price": ("sum", "price"),
            "net": ("sum", "net"),
            "code_a": ("mode", "code_a"),
            "code_b": ("mode", "code_b"),
        },
    )
    return g.withColumn("price", from_fixed("price")).withColumn("net", from_fixed("net"))


LINE_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "first_line_per_order",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS rn
        FROM lineitem WHERE l_orderkey IS NOT NULL) WHERE rn = 1""",
)
def q_first_line_per_order(spark: SparkSession, d: str) -> DataFrame:
    """A5: first line of every order under an explicit total order (the dedup keep-first rule)."""
    return first_row(T(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER)


@query(
    "compact_month_parse",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS ym, CAST(strptime(strftime(o_orderdate, '%Y%m'), '%Y%m') AS DATE) AS month
       FROM orders""",
)
def q_compact_month_parse(spark: SparkSession, d: str) -> DataFrame:
    """S4: 'yyyyMM' month text parsed back to a month-start date."""
    o = T(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("ym"))
    return o.withColumn("month", parse_compact_month("ym"))


# ----------------------------------------------------------------- E1 E2
@query(
    "dictionary_codes",
    f"""WITH k AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_custkey AS ord FROM customer),
        {_sql_dict("c_mktsegment")}, {_sql_dict("c_nationkey")}
        SELECT k.c_custkey, k.c_mktsegment, k.c_nationkey, d_c_mktsegment.code AS c_mktsegment_code,
               d_c_nationkey.code AS c_nationkey_code
        FROM k {_sql_join_dict("c_mktsegment")} {_sql_join_dict("c_nationkey")}""",
)
def q_dictionary_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes by order of first appearance (customer key order)."""
    c = T(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return factorize(c, ["c_mktsegment", "c_nationkey"], ["c_custkey"], suffix="_code")


SQL_DICT_FIT = f"""
WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority,
                  strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS ord
           FROM orders),
tr AS (SELECT * FROM o WHERE ord < '{DICT_TRAIN_BEFORE.replace("-", "")}'),
{_sql_dict("year", "tr")}, {_sql_dict("o_orderpriority", "tr")}
SELECT o.o_orderkey, o.year AS year_raw, o.o_orderpriority AS priority_raw,
       COALESCE(d_year.code, -1) AS year, COALESCE(d_o_orderpriority.code, -1) AS o_orderpriority
FROM o LEFT JOIN d_year ON o.year = d_year.v LEFT JOIN d_o_orderpriority ON o.o_orderpriority = d_o_orderpriority.v
"""


@query("dictionary_fit_transform", SQL_DICT_FIT)
def q_dictionary_fit_transform(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary fitted on the training period, applied to all orders; unseen values -> -1."""
    o = T(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("year"), "o_orderpriority"
    )
    o = o.withColumns({"year_raw": F.col("year"), "priority_raw": F.col("o_orderpriority")})
    enc = DictionaryEncoder(["year", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    enc.fit(o.where(F.col("o_orderdate").cast("date") < F.to_date(F.lit(DICT_TRAIN_BEFORE))))
    return enc.transform(o).select("o_orderkey", "year_raw", "priority_raw", "year", "o_orderpriority")


# -------------------------------------------------------------- E3 E4 O8
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SQL_ONE_HOT = f"""
SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'train' ELSE 'test' END AS split,
       {", ".join(f"CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END AS p_type_{v}" for v in P_TYPES)}
FROM part
"""


@query("one_hot_aligned", SQL_ONE_HOT)
def q_one_hot_aligned(spark: SparkSession, d: str) -> DataFrame:
    """E3 + E4 + O8: one-hot fitted on the train split, applied to both, stacked back by name."""
    p = T(spark, d, "part").select("p_partkey", "p_type", "p_size")
    train = p.where(F.col("p_size") <= 25).withColumn("split", F.lit("train"))
    test = p.where(~(F.col("p_size") <= 25)).withColumn("split", F.lit("test"))
    fitted = fit_one_hot(train, ["p_type"])
    enc = [one_hot(x, fitted).drop("p_size") for x in (train, test)]
    return stack(enc)


# ------------------------------------------------------------- M1 P5-P8
SQL_PERIOD_SPLIT = f"""
SELECT g.sid, g.id, g.year, g.quarter, g.y,
       CASE WHEN c.c_custkey IS NULL THEN 'train'
            WHEN g.year = {TARGET_YEAR} AND g.quarter = {TARGET_QUARTER} THEN 'predict' ELSE 'valid' END AS split
FROM ({SQL_QUARTERLY}) g
LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment IN {TEST_SEGMENTS!r}) c ON g.id = c.c_custkey
"""


@query("period_split", SQL_PERIOD_SPLIT)
def q_period_split(spark: SparkSession, d: str) -> DataFrame:
    """M1 (P7 P8): train entities -> train; test entities -> valid, target quarter -> predict."""
    panel = q_quarterly_panel(spark, d).select("sid", "id", "year", "quarter", "y")
    test_ids = T(spark, d, "customer").where(F.col("c_mktsegment").isin(*TEST_SEGMENTS)).select(F.col("c_custkey").alias("id"))
    return period_split(panel, test_ids, "id", "year", "quarter", TARGET_YEAR, TARGET_QUARTER)


@query(
    "row_key_roundtrip",
    f"""SELECT sid, CAST(substr(sid, 1, length(sid) - 6) AS BIGINT) AS id, CAST(substr(sid, length(sid) - 5, 4) AS INTEGER) AS year,
               CAST(substr(sid, length(sid) - 1, 2) AS INTEGER) AS quarter,
               CASE WHEN CAST(substr(sid, length(sid) - 5, 4) AS INTEGER) = {TARGET_YEAR}
                     AND CAST(substr(sid, length(sid) - 1, 2) AS INTEGER) = {TARGET_QUARTER} THEN 'predict' ELSE 'valid' END AS split
        FROM ({SQL_QUARTERLY})""",
)
def q_row_key_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """P5 + P6 + P7: build the row key, parse it back from the right, tag the split."""
    sid = q_quarterly_panel(spark, d).select("sid")
    parts = parse_row_key("sid")
    out = sid.select("sid", *[v.alias(k) for k, v in parts.items()])
    return out.withColumn("split", tag_split("year", "quarter", TARGET_YEAR, TARGET_QUARTER))
