"""The data model built from the given tables, and the same tables as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.session import spread, table

START = 1_704_067_200_000_000  # 2024-01-01 in microseconds
QUARTER = 900_000_000
CLASS_OF = {"error": "CREDIT_EVENT", "purchase": "EARNINGS", "signup": "MANAGEMENT_CHANGE", "click": "PRODUCT_LAUNCH", "view": "OTHER"}
BURN_IN_END = START + 10 * 86_400_000_000


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = F.create_map(*[F.lit(x) for kv in CLASS_OF.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("seq"),
        (us - us % QUARTER).alias("t"),
        F.col("event_type").alias("ticker"),
        (F.col("user_id") % 20).cast("long").alias("outlet"),
        ((F.col("value") - 50) / (F.col("value") + 50)).alias("sentiment"),
        (0.5 + (F.col("event_id") % 50) / 100.0).alias("relevance"),
        (0.3 + (F.col("event_id") % 7) / 10.0).alias("event_confidence"),
        F.col("user_id").cast("long").alias("story"),
        F.try_element_at(kinds, F.col("event_type")).alias("event_class"),
        (F.col("user_id") % 5).cast("long").alias("region"),
    )


MENTIONS = """mentions AS (
  SELECT CAST(event_id AS BIGINT) AS seq, epoch_us(ts) - epoch_us(ts) % 900000000 AS t, event_type AS ticker, CAST(user_id % 20 AS BIGINT) AS outlet,
    (value - 50) / (value + 50) AS sentiment, 0.5::DOUBLE + (event_id % 50) / 100.0::DOUBLE AS relevance, 0.3::DOUBLE + (event_id % 7) / 10.0::DOUBLE AS event_confidence,
    CAST(user_id AS BIGINT) AS story, CASE event_type WHEN 'error' THEN 'CREDIT_EVENT' WHEN 'purchase' THEN 'EARNINGS' WHEN 'signup' THEN 'MANAGEMENT_CHANGE'
      WHEN 'click' THEN 'PRODUCT_LAUNCH' WHEN 'view' THEN 'OTHER' END AS event_class, CAST(user_id % 5 AS BIGINT) AS region FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with a raw impact and a severity of ten equal steps."""
    raw = F.abs("sentiment") * F.col("event_confidence") * F.col("relevance")
    step = F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(F.col("raw") * 10))).cast("int")
    return mentions(spark, sf_dir).withColumn("raw", raw).withColumn("severity", step)


SCORED = MENTIONS + """, scored AS (
  SELECT *, CAST(least(10, greatest(1, ceil(raw * 10))) AS INTEGER) AS severity FROM (SELECT *, abs(sentiment) * event_confidence * relevance AS raw FROM mentions))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, on all cores: patterns and word lists over whole texts are the work of most queries."""
    return spread(table(spark, sf_dir, "documents"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text", "lang", "source", (F.lit(START) + F.col("doc_id") * QUARTER).alias("t"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly ``session, symbol, close, volume``; symbols are order priorities. Prices are whole cents."""
    session = F.to_date(F.date_trunc("week", F.col("o_orderdate").cast("timestamp")))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(session.alias("session"), F.col("o_orderpriority").alias("symbol"))
        .agg((cents.cast("double") / F.count("*") / 100).alias("close"), F.count("*").alias("volume"))
    )


SYMBOLS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
PRICES = """prices AS (
  SELECT CAST(date_trunc('week', CAST(o_orderdate AS TIMESTAMP)) AS DATE) AS session, o_orderpriority AS symbol,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS close, count(*) AS volume FROM orders GROUP BY 1, 2)"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with ``n, ret`` and the market's return of the same session."""
    from quillrisk.operators.market import returns

    all_prices = prices(spark, sf_dir)
    index = all_prices.groupBy("session").agg(F.sum(F.col("close") * F.col("volume")).alias("v"), F.sum("volume").alias("n"))
    index = index.select("session", (F.col("v") / F.col("n")).alias("close"), F.lit("market").alias("symbol"))
    moves = returns(index).select("session", F.col("ret").alias("market"))
    return returns(all_prices).join(moves, "session")


MARKET = PRICES + """, idx AS (SELECT session, sum(close * volume) / sum(volume) AS c FROM prices GROUP BY 1),
  moves AS (SELECT session, c / lag(c) OVER (ORDER BY session) - 1 AS market FROM idx),
  market AS (SELECT p.*, p.close / lag(p.close) OVER w - 1 AS ret, row_number() OVER w AS n, m.market FROM prices p JOIN moves m USING (session) WINDOW w AS (PARTITION BY symbol ORDER BY p.session))"""


#: Fixed values of the made-up book: instruments by turns, with their classes, ratings, regions and currencies.
INSTRUMENTS = ("sovereign_bond", "corporate_bond", "loan", "irs", "fx_forward", "equity_option", "equity_trs", "cds", "equity")
ASSET_CLASS = ("bond", "bond", "loan", "derivative", "derivative", "derivative", "derivative", "derivative", "equity")
SHORT_SIDE = {"irs": "receive_fixed", "fx_forward": "short_foreign", "equity_trs": "pay_equity", "cds": "protection_sold"}
RATINGS, REGIONS, CURRENCIES = ("AAA", "AA", "A", "BBB", "BB", "B", "CCC"), ("US", "EUROPE", "ASIA", "LATAM", "AFRICA"), ("EUR", "JPY", "GBP")
#: Spread of BBB in basis points, before any shock.
BBB_BP = 110.0


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    turn, rating = F.col("l_orderkey") + F.col("l_linenumber"), F.col("l_suppkey") % 7
    rated, years = F.col("l_partkey") % 11 > 0, 0.25 + F.col("l_quantity") / 5
    kind, notional, short = pick(INSTRUMENTS, turn), F.col("l_extendedprice").cast("double"), F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("position"),
        pick(ASSET_CLASS, turn).alias("asset_class"),
        kind.alias("instrument"),
        F.when(rated, pick(RATINGS, rating)).alias("rating"),
        F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit("sector"), (F.col("l_partkey") % 5).cast("string"))).alias("sector"),
        pick(REGIONS, F.col("l_suppkey")).alias("region"),
        pick(CURRENCIES, F.col("l_partkey")).alias("currency"),
        short.alias("short"),
        notional.alias("notional"),
        (notional * 0.98).alias("market_value"),
        years.alias("maturity"),
        (years * 0.9).alias("duration"),
        (years * years).alias("convexity"),
        (notional * years * 0.0001).alias("dv01"),
        (notional * years * 0.00008).alias("spread_dv01"),
        F.when(rated, 0.25 + rating * 0.25).alias("spread_ratio"),
        (notional * 0.0055).alias("delta"),
        (notional * 0.0001).alias("gamma"),
        (notional * 0.3).alias("vega"),
        notional.alias("ead"),
        (0.01 * (rating + 1)).alias("pd"),
        F.lit(0.45).alias("lgd"),
        (years * 0.85).alias("spread_duration"),
        (0.5 + (F.col("l_partkey") % 10) / 10.0).alias("beta"),
    )


def _list(values: tuple) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


POSITIONS = f"""positions AS (SELECT *, notional * 0.98::DOUBLE AS market_value, maturity * 0.9::DOUBLE AS duration, maturity * maturity AS convexity, notional * maturity * 0.0001::DOUBLE AS dv01,
    notional * maturity * 0.00008::DOUBLE AS spread_dv01, notional * 0.0055::DOUBLE AS delta, notional * 0.0001::DOUBLE AS gamma, notional * 0.3::DOUBLE AS vega, notional AS ead, 0.45::DOUBLE AS lgd,
    maturity * 0.85::DOUBLE AS spread_duration FROM (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS position, {_list(ASSET_CLASS)}[CAST((l_orderkey + l_linenumber) % 9 + 1 AS INTEGER)] AS asset_class,
      {_list(INSTRUMENTS)}[CAST((l_orderkey + l_linenumber) % 9 + 1 AS INTEGER)] AS instrument, CASE WHEN l_partkey % 11 > 0 THEN {_list(RATINGS)}[CAST(l_suppkey % 7 + 1 AS INTEGER)] END AS rating,
      CASE WHEN l_partkey % 5 > 0 THEN 'sector' || (l_partkey % 5) END AS sector, {_list(REGIONS)}[CAST(l_suppkey % 5 + 1 AS INTEGER)] AS region, {_list(CURRENCIES)}[CAST(l_partkey % 3 + 1 AS INTEGER)] AS currency,
      l_returnflag = 'R' AS short, CAST(l_extendedprice AS DOUBLE) AS notional, 0.25::DOUBLE + l_quantity / 5 AS maturity, CASE WHEN l_partkey % 11 > 0 THEN 0.25::DOUBLE + (l_suppkey % 7) * 0.25::DOUBLE END AS spread_ratio,
      0.01::DOUBLE * (l_suppkey % 7 + 1) AS pd, 0.5::DOUBLE + (l_partkey % 10) / 10.0::DOUBLE AS beta FROM lineitem))"""

#: Three made-up scenarios: rates and credit in basis points, volatility in points, equity and currencies as returns; regions that the event hits.
FACTORS = ("rate_3m", "rate_10y", "credit", "vol", "equity")
SCENARIOS = {
    "rates up": {"rate_3m": 200.0, "rate_10y": 150.0, "credit": 50.0, "vol": 5.0, "equity": -0.05, "fx": {"EUR": 0.01}, "sectors": {"sector1": -0.08}, "regions": ["US"]},
    "credit": {"rate_3m": -50.0, "rate_10y": -100.0, "credit": 300.0, "vol": 15.0, "equity": -0.15, "fx": {"EUR": -0.02, "GBP": -0.04}, "sectors": {"sector1": -0.3, "sector2": -0.2}, "regions": ["EUROPE", "US"]},
    "crash": {"rate_3m": -100.0, "rate_10y": -50.0, "credit": -150.0, "vol": 40.0, "equity": -0.35, "fx": {"JPY": 0.08}, "sectors": {}, "regions": ["ASIA"]},
}
SHOCKS = f"run string, {', '.join(f'{f} double' for f in FACTORS)}, fx map<string,double>, sectors map<string,double>, regions array<string>"


def scenarios(spark: SparkSession, moves: dict[str, dict] = SCENARIOS) -> DataFrame:
    """The scenarios in one split, since a product reads its other side once for each."""
    rows = [(run, *[m.get(f, 0.0) for f in FACTORS], m.get("fx", {}), m.get("sectors", {}), m.get("regions", [])) for run, m in moves.items()]
    return spark.createDataFrame(rows, SHOCKS).coalesce(1)


def shock_rows(moves: dict[str, dict]) -> str:
    """The scenarios as SQL tables ``shocks``, ``fx_moves``, ``sector_moves`` and ``hits``."""
    values = lambda rows, n: "VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows or [["NULL"] * n])
    base = values([[f"'{run}'", *[f"{m.get(f, 0.0)}::DOUBLE" for f in FACTORS]] for run, m in moves.items()], 0)
    pairs = lambda kind: values([[f"'{run}'", f"'{k}'", f"{v}::DOUBLE"] for run, m in moves.items() for k, v in m.get(kind, {}).items()], 3)
    hits = values([[f"'{run}'", f"'{r}'"] for run, m in moves.items() for r in m.get("regions", [])], 2)
    return f"""shocks(run, {', '.join(FACTORS)}) AS ({base}), fx_moves(run, currency, fx_move) AS ({pairs('fx')}), sector_moves(run, sector, sector_move) AS ({pairs('sectors')}), hits(run, region) AS ({hits})"""


def valued_sql(moves: dict[str, dict] = SCENARIOS) -> str:
    return POSITIONS + ", " + shock_rows(moves) + f""",
  moved AS (SELECT *, CASE WHEN maturity <= 0.25 THEN rate_3m WHEN maturity >= 10 THEN rate_10y ELSE rate_3m + (rate_10y - rate_3m) * (maturity - 0.25::DOUBLE) / 9.75::DOUBLE END AS rate,
      coalesce(credit * spread_ratio, 0.0) AS sp, coalesce(sector_move, equity) AS eq, coalesce(fx_move, 0.0) AS fx, CASE WHEN short THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS side,
      greatest(0.0::DOUBLE, 1 + credit / {BBB_BP}::DOUBLE) * CASE WHEN hits.region IS NOT NULL AND hits.region <> 'US' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS factor
    FROM positions p CROSS JOIN shocks s LEFT JOIN fx_moves f USING (run, currency) LEFT JOIN sector_moves m USING (run, sector) LEFT JOIN hits ON hits.run = s.run AND hits.region = p.region),
  priced AS (SELECT *, CASE WHEN instrument = 'sovereign_bond' THEN market_value * (-duration * (rate / 10000) + 0.5::DOUBLE * convexity * (rate / 10000) * (rate / 10000))
      WHEN instrument = 'corporate_bond' THEN market_value * (-duration * ((rate + sp) / 10000) + 0.5::DOUBLE * convexity * ((rate + sp) / 10000) * ((rate + sp) / 10000))
      WHEN instrument = 'irs' THEN side * dv01 * rate WHEN instrument = 'fx_forward' THEN side * notional * fx WHEN instrument = 'equity_option' THEN delta * (100 * eq) + 0.5::DOUBLE * gamma * (100 * eq) * (100 * eq) + vega * (vol / 100)
      WHEN instrument = 'equity_trs' THEN side * notional * eq WHEN instrument = 'cds' THEN side * spread_dv01 * sp WHEN instrument = 'equity' THEN market_value * eq ELSE 0.0::DOUBLE END AS pnl,
      CASE WHEN instrument = 'loan' THEN -spread_duration * sp / 10000 * ead ELSE 0.0::DOUBLE END AS loan_fv, CASE WHEN instrument = 'loan' THEN least(1.0::DOUBLE, pd * factor) ELSE pd END AS pd_stressed FROM moved),
  valued AS (SELECT *, (pd_stressed - pd) * lgd * ead AS d_el, pnl - (pd_stressed - pd) * lgd * ead AS impact FROM priced)"""


VALUED = valued_sql()


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("merchant"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").cast("double").alias("amount"), F.col("o_orderpriority").alias("code")
    )


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
