"""Merchant rollups, ratings, position pricing and portfolio stress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillrisk.operators.totals import places


def merchant_rollup(rows: DataFrame) -> DataFrame:
    """``rows``: ``merchant, month, amount, code``. Monthly totals, then their mean, deviation and variation, and the commonest code."""
    cents = F.sum(F.round(F.col("amount") * 100).cast("long"))  # exact in any order
    months = rows.groupBy("merchant", "month").agg((cents / 100).alias("total"), cents.alias("cents"), F.count("*").alias("n"))
    sums = months.groupBy("merchant").agg(
        (F.sum("cents") / 100).alias("volume"), F.count("*").alias("months"), (F.sum("cents") / F.count("*") / 100).alias("mean"), F.stddev_samp("total").alias("std"), F.sum("n").alias("transactions")
    )
    codes = rows.where("code IS NOT NULL").groupBy("merchant", "code").agg(F.count("*").alias("n"))
    modal = codes.groupBy("merchant").agg(F.max_by("code", F.struct("n", "code")).alias("code"))
    return sums.withColumn("variation", F.col("std") / F.col("mean")).join(modal, "merchant", "left")


def top_per_sector(rows: DataFrame, slots: int, floor: int) -> DataFrame:
    """The largest of each sector; slots go by the square root of the sector's volume, at least ``floor`` each."""
    sectors = rows.groupBy("sector").agg(F.sqrt(F.sum("volume")).alias("root"))
    share = F.col("root") / F.sum("root").over(Window.partitionBy())  # a row a sector
    alloc = sectors.select("sector", F.greatest(F.lit(floor), F.bround(share * slots).cast("int")).alias("alloc"))
    rank = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("volume"), "merchant"))
    return rows.withColumn("rank", rank).join(alloc, "sector").where(F.col("rank") <= F.col("alloc"))


def rating_by_rank(rows: DataFrame, value: str, mix: list[tuple[str, float]], sector: str = "sector") -> DataFrame:
    """Add ``rating``: rows of a sector in the order of ``value``, cut at the cumulative shares of ``mix``."""
    sizes = rows.groupBy(sector).agg(F.count("*").alias("_all"))
    placed = places(rows, sector, value, "merchant", "_place").join(sizes, sector)
    place = (F.col("_place") + 0.5) / F.col("_all")
    cuts, total = [], 0.0
    for _, share in mix:
        total += share
        cuts.append(total)
    index = F.size(F.filter(F.array(*map(F.lit, cuts[:-1])), lambda c: c <= place))
    return placed.withColumn("rating", F.element_at(F.array(*[F.lit(r) for r, _ in mix]), index + 1)).drop("_place", "_all")


def bond_analytics(coupon: Column, rate: Column, years: Column, frequency: int = 2) -> Column:
    """``(price, duration, convexity)`` of a unit bond: a fold over its payments."""
    n = F.greatest(F.lit(1), F.bround(years * frequency).cast("int"))
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("d"), F.lit(0.0).alias("c"))
    base = 1 + rate / frequency

    def pay(s: Column, k: Column) -> Column:
        cash = coupon / frequency + F.when(k == n, 1.0).otherwise(0.0)
        value = cash / F.pow(base, k.cast("double"))
        t = k.cast("double") / frequency
        return F.struct((s["p"] + value).alias("p"), (s["d"] + value * t).alias("d"), (s["c"] + value * t * (t + 1.0 / frequency)).alias("c"))

    out = F.aggregate(F.sequence(F.lit(1), n), start, pay)
    return F.struct(out["p"].alias("price"), (out["d"] / out["p"] / base).alias("duration"), (out["c"] / out["p"] / (base * base)).alias("convexity"))


def _payments(years: Column, frequency: int, value) -> Column:
    """Sum of ``value`` over the numbers of the payments, at least one, divided by their frequency."""
    n = F.greatest(F.lit(1), F.bround(years * frequency).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + value(k.cast("double"))) / frequency


def annuity(rate: Column, years: Column, frequency: int = 2) -> Column:
    """Value of 1 a year, paid ``frequency`` times a year; null rates or years give null."""
    return _payments(years, frequency, lambda k: F.pow(1 + rate / frequency, -k))


def swap_dv01(notional: Column, rate: Column, years: Column) -> Column:
    """Change of a swap's fixed leg for one basis point, a positive number."""
    return notional * annuity(rate, years) * 0.0001


def cds_risky_duration(spread: Column, lgd: Column, rate: Column, years: Column, frequency: int = 4) -> Column:
    """Annuity that ends with default: a flat hazard rate of spread over loss given default."""
    hazard = spread / F.greatest(lgd, F.lit(1e-6))
    return _payments(years, frequency, lambda k: F.exp(-(rate + hazard) * (k / frequency)))


def curve_rate(years: Column, short: Column, ten: Column) -> Column:
    """Between the three-month and the ten-year value by maturity, flat beyond both."""
    between = short + (ten - short) * (years - 0.25) / 9.75
    return F.when(years <= 0.25, short).when(years >= 10, ten).otherwise(between)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def black_scholes(spot: Column, strike: Column, years: Column, rate: Column, vol: Column, call: Column | bool = True) -> Column:
    """``(price, delta, gamma, vega)`` of a call or a put; vega is for a volatility of 1, and an option past its end counts as nearly there."""
    call = F.lit(call) if isinstance(call, bool) else call
    years = F.greatest(years, F.lit(1e-6))
    root = vol * F.sqrt(years)
    d1 = (F.ln(spot / strike) + (rate + 0.5 * vol * vol) * years) / root
    density, paid = F.exp(-d1 * d1 / 2) * 0.3989422804014327, strike * F.exp(-rate * years)
    price = F.when(call, spot * normal_cdf(d1) - paid * normal_cdf(d1 - root)).otherwise(paid * normal_cdf(root - d1) - spot * normal_cdf(-d1))
    delta = normal_cdf(d1) - F.when(call, 0.0).otherwise(1.0)
    return F.struct(price.alias("price"), delta.alias("delta"), (density / (spot * root)).alias("gamma"), (spot * density * F.sqrt(years)).alias("vega"))


def strongest_moves(moves: DataFrame, by: list[str]) -> DataFrame:
    """``(by, factor, value, driver)``: the largest move of each factor by size, the first analogue among equals.

    ``moves``: ``by, factor, value, analogue, place``.
    """
    best = F.max_by(F.struct("value", "analogue"), F.struct(F.abs("value"), -F.col("place")))
    return moves.groupBy(*by, "factor").agg(best.alias("_m")).select(*by, "factor", F.col("_m.value").alias("value"), F.col("_m.analogue").alias("driver"))


def severity_multiplier(impact: Column, table: dict[int, float]) -> Column:
    """Table look-up, clamped at the top; zero below the table."""
    low, high = min(table), max(table)
    values = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(impact < low, 0.0).otherwise(F.element_at(values, F.least(F.lit(high), impact).cast("int")))


def revalue(positions: DataFrame, shocks: DataFrame, bbb_bp: float, regional: float = 1.5, home: str = "US") -> DataFrame:
    """Every position under every run, with ``pnl`` (marked to market), ``loan_fv`` (a loan's fair value, for information),
    ``pd_stressed``, ``d_el`` (change of expected loss) and ``impact`` (pnl less d_el).

    ``shocks``: ``run``; ``rate_3m, rate_10y, credit`` in basis points, ``vol`` in points, ``equity`` as a return; maps ``fx`` by currency and
    ``sectors`` of returns that go before ``equity``; ``regions`` that the event hits. Missing moves and sensitivities count as zero, an unrated position
    has no spread move, a sovereign neither. The scenarios are the small side and are sent whole only if Spark's size check allows.
    """
    both = positions.crossJoin(shocks)  # every scenario prices every position: this product is the result
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    kind = F.col("instrument")
    loan = kind == "loan"
    # Moves are columns before they are used: written out wherever they occur, they make a method that the JVM does not compile.
    both = both.withColumns({
        "_rate": curve_rate(F.coalesce("maturity", F.lit(1.0)), z("rate_3m"), z("rate_10y")),
        "_spread": F.coalesce(z("credit") * F.col("spread_ratio"), F.lit(0.0)),
        "_side": F.when(F.col("short"), -1.0).otherwise(1.0),
        "_equity": F.coalesce(F.try_element_at("sectors", F.col("sector")), z("equity")),
        "_fx": F.coalesce(F.try_element_at("fx", F.col("currency")), F.lit(0.0)),
        "_hit": F.coalesce(F.array_contains("regions", F.col("region")), F.lit(False)) & (F.col("region") != home),
    })
    both = both.withColumns({
        "_dy": F.when(kind == "corporate_bond", F.col("_rate") + F.col("_spread")).otherwise(F.col("_rate")) / 10000,
        "_jump": 100 * F.col("_equity"),
        "_factor": F.greatest(F.lit(0.0), 1 + z("credit") / bbb_bp) * F.when(F.col("_hit"), regional).otherwise(1.0),
    })
    rate, spread, side, equity, dy, jump = (F.col(c) for c in ("_rate", "_spread", "_side", "_equity", "_dy", "_jump"))
    pnl = F.when(kind.isin("sovereign_bond", "corporate_bond"), z("market_value") * (-z("duration") * dy + 0.5 * z("convexity") * dy * dy))
    pnl = pnl.when(kind == "irs", side * z("dv01") * rate).when(kind == "fx_forward", side * z("notional") * F.col("_fx"))
    pnl = pnl.when(kind == "equity_option", z("delta") * jump + 0.5 * z("gamma") * jump * jump + z("vega") * (z("vol") / 100))
    pnl = pnl.when(kind == "equity_trs", side * z("notional") * equity).when(kind == "cds", side * z("spread_dv01") * spread)
    pnl = pnl.when(kind == "equity", z("market_value") * equity).otherwise(0.0)
    out = both.withColumns({
        "pnl": pnl,
        "loan_fv": F.when(loan, -z("spread_duration") * spread / 10000 * z("ead")).otherwise(0.0),
        "pd_stressed": F.when(loan, F.least(F.lit(1.0), z("pd") * F.col("_factor"))).otherwise(z("pd")),
    })
    out = out.withColumn("d_el", (F.col("pd_stressed") - z("pd")) * z("lgd") * z("ead")).withColumn("impact", F.col("pnl") - F.col("d_el"))
    return out.select("run", *positions.columns, "pnl", "loan_fv", "pd_stressed", "d_el", "impact")


#: What a position's price depends on besides its amounts, and the amounts that it is in proportion to.
DRIVERS = {
    "sovereign_bond": ("maturity", "duration", "convexity"),
    "corporate_bond": ("maturity", "duration", "convexity", "spread_ratio"),
    "irs": ("maturity", "short"),
    "fx_forward": ("currency", "short"),
    "equity_option": ("sector",),
    "equity_trs": ("sector", "short"),
    "cds": ("spread_ratio", "short"),
    "equity": ("sector",),
    "loan": ("spread_ratio", "spread_duration", "pd", "lgd", "region"),
}
AMOUNTS = ("market_value", "notional", "dv01", "spread_dv01", "delta", "gamma", "vega", "ead")


def condense(positions: DataFrame) -> DataFrame:
    """Positions that every scenario moves in proportion, as one with the sum of their amounts: the totals of ``revalue`` over it are those of the whole book.

    What an instrument's price does not depend on is null, so that the rows are as many as there are different terms, not positions.
    """
    drivers = sorted({c for of in DRIVERS.values() for c in of})
    of = lambda c: F.when(F.col("instrument").isin(*[k for k, v in DRIVERS.items() if c in v]), F.col(c))
    terms = positions.select("instrument", *[of(c).alias(c) for c in drivers], *AMOUNTS)
    return terms.groupBy("instrument", *drivers).agg(*[F.sum(c).alias(c) for c in AMOUNTS])


def risk_weight(corporate: dict[str, float], sovereign: dict[str, float], equity: float) -> Column:
    """The weight of a position by class and rating; unrated corporates weigh ``corporate['UNRATED']``, unrated sovereigns 1."""
    of = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce("rating", F.lit("UNRATED")))
    other = F.coalesce(of(corporate), F.lit(corporate["UNRATED"]))
    return F.when(F.col("instrument") == "sovereign_bond", F.coalesce(of(sovereign), F.lit(1.0))).when(F.col("asset_class") == "equity", equity).otherwise(other)


def exposure(pnl: Column) -> Column:
    """What the weight applies to: a loan's exposure, the market value of bonds and shares, and of derivatives what is above zero."""
    value = F.coalesce("market_value", F.lit(0.0)) + pnl
    return F.when(F.col("asset_class") == "loan", F.col("ead")).when(F.col("asset_class").isin("bond", "equity"), value).otherwise(F.greatest(value, F.lit(0.0)))


def capital_view(values: DataFrame, weight: Column, ratio: float = 0.13) -> DataFrame:
    """``(run, rwa_before, rwa_after, cet1_before, cet1_after, ratio_after, losses, from_mtm, from_d_el)``; capital starts at ``ratio`` of the weighted assets."""
    each = values.withColumns({"_b": exposure(F.lit(0.0)) * weight, "_a": exposure(F.col("pnl")) * weight}).groupBy("run")
    mtm = F.sum(F.when(F.col("asset_class") != "loan", F.col("pnl")).otherwise(0.0))
    sums = each.agg(F.sum("_b").alias("rwa_before"), F.sum("_a").alias("rwa_after"), (-mtm).alias("from_mtm"), F.sum("d_el").alias("from_d_el"))
    before, losses = ratio * F.col("rwa_before"), F.col("from_mtm") + F.col("from_d_el")
    return sums.withColumns({"cet1_before": before, "losses": losses}).withColumn("cet1_after", F.col("cet1_before") - F.col("losses")).withColumn(
        "ratio_after", F.when(F.col("rwa_after") != 0, F.col("cet1_after") / F.col("rwa_after"))
    )


def stress_many(signals: DataFrame, shocks: DataFrame, key: list[str], positions: DataFrame, bbb_bp: float) -> DataFrame:
    """``signals`` with the totals ``pnl, d_el, loan_fv`` of the whole book under each one's scenario.

    ``shocks`` has a row for each ``key`` that signals can have. Signals of one key share a scenario, so each scenario that some signal asks for is priced once, and its totals
    are joined to all its signals. The book is condensed first: the work is positions, plus different terms times distinct scenarios, whatever the number of signals.
    """
    wanted = shocks.join(signals.select(*key).distinct(), key, "left_semi").withColumn("run", F.to_json(F.struct(*key)))
    totals = revalue(condense(positions), wanted.drop(*key), bbb_bp).groupBy("run").agg(*[F.sum(c).alias(c) for c in ("pnl", "d_el", "loan_fv")])
    return signals.withColumn("run", F.to_json(F.struct(*key))).join(totals, "run").drop("run")


def breakdowns(values: DataFrame, by: list[str], value: str = "impact") -> DataFrame:
    """``(run, dimension, member, total)``: one pass for all dimensions; null members are ``n/a``."""
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("n/a")).alias("member")) for d in by])
    each = values.select("run", value, F.explode(parts).alias("p"))
    return each.groupBy("run", F.col("p.dimension").alias("dimension"), F.col("p.member").alias("member")).agg(F.sum(value).alias("total"))


def worst_positions(values: DataFrame, n: int = 10, value: str = "impact", id_col: str = "position") -> DataFrame:
    """The ``n`` rows of every run with the least ``value``, ties by id, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy(value, id_col))
    return values.withColumn("rank", rank).where(F.col("rank") <= n)


def trigger_gates(signals: DataFrame, least_impact: int = 8, least_confidence: float = 0.6, least_outlets: int = 2, most_sentiment: float = -0.15) -> DataFrame:
    """Add ``reason``: the first gate that blocks a signal, or ``pass``."""
    reason = F.when(F.col("impact") < least_impact, "impact").when(F.col("confidence") < least_confidence, "confidence")
    reason = reason.when(F.col("outlets") < least_outlets, "sources").when(F.col("sentiment") >= most_sentiment, "sentiment").otherwise("pass")
    return signals.withColumn("reason", reason)


def cooldown(signals: DataFrame, key: str, t: str = "t", seq: str = "seq", impact: str = "impact", hours: float = 24.0) -> DataFrame:
    """Add ``decision`` to gate-passing signals: ``fired``, ``escalation`` or ``cooldown``.

    Within the cooldown of a key's last firing only a higher impact fires, and it restarts time and level; a signal exactly ``hours`` later fires.
    A pause of ``hours`` or more always ends a cooldown, so a key's life is cut there into segments, told from a row a day. A segment's
    signals are read in order of time and ``seq`` (unique), a batch at a time, with one firing as all there is to remember.
    """
    span = int(hours * 3_600_000_000)
    rows = signals.select(F.col(key).alias("key"), F.col(t).alias("t"), F.col(seq).alias("seq"), F.col(impact).alias("impact"))
    rows = rows.withColumn("day", F.floor(F.col("t") / span))  # no pause fits into a day of this length
    days = rows.groupBy("key", "day").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    over = Window.partitionBy("key").orderBy("day")
    pause = (F.col("first") - F.lag("last").over(over) >= span).cast("int")
    days = days.withColumn("pause", F.coalesce(pause, F.lit(0)))
    days = days.select(F.col("key").alias("_key"), F.col("day").alias("_day"), F.sum("pause").over(over).alias("segment"))
    rows = rows.join(days, F.col("key").eqNullSafe(F.col("_key")) & (F.col("day") == F.col("_day"))).select("key", "t", "seq", "impact", "segment")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, level = None, None, 0
        for batch in batches:
            out = []
            for *k, when, high in zip(batch["key"].tolist(), batch["segment"].tolist(), batch["t"].tolist(), batch["impact"].tolist()):
                if k != held:
                    held, at, level = k, None, 0
                decision = "fired" if at is None or when - at >= span else "escalation" if high > level else "cooldown"
                if decision != "cooldown":
                    at, level = when, high
                out.append(decision)
            yield pd.DataFrame({"seq": batch["seq"], "decision": out})

    kind = rows.schema["seq"].dataType.simpleString()
    ordered = rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "t", "seq")
    done = ordered.mapInPandas(run, f"seq {kind}, decision string")
    return signals.join(done.withColumnRenamed("seq", seq), seq)
