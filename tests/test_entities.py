"""Entity links: ambiguous names, executives, bare names, organisations, priors, the market, and a plain Python count of whole phrases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillrisk.operators import entities

COMPANIES = [
    entities.company("JPM", "JPMorgan Chase & Co.", ["JPMorgan", "JPMorgan Chase", "JP Morgan"], ambiguous=("Chase",), brands=("Chase",), execs=("Jamie Dimon",), cashtags=("$JPM",), bare=("JPM",)),
    entities.company("BAC", "Bank of America Corporation", ["Bank of America", "BofA"], brands=("Merrill",), cashtags=("$BAC",), bare=("BAC",)),
    entities.company("AAPL", "Apple Inc.", ["Apple"], ambiguous=("Apple",), brands=("iPhone",), execs=("Tim Cook",), cashtags=("$AAPL",), bare=("AAPL",)),
    entities.company("GOOGL", "Alphabet Inc.", ["Alphabet", "Google"], cashtags=("$GOOGL", "$GOOG"), bare=("GOOGL", "GOOG")),
    entities.company("KO", "The Coca-Cola Company", ["Coca-Cola"], cashtags=("$KO",)),
    entities.company("META", "Meta Platforms", ["Meta Platforms"], ambiguous=("Meta",), brands=("Instagram",), cashtags=("$META",)),
    entities.company("BA", "Boeing", ["Boeing"], execs=("Dave Calhoun",), cashtags=("$BA",)),
]
RULES = entities.Rules(
    phrases=tuple(p for ps, _ in COMPANIES for p in ps) + tuple(("", "context", w) for w in ("shares", "ad revenue", "sales", "analysts")) + tuple(("", "market", w) for w in ("inflation", "invasion", "raises rates")),
    orgs=tuple(o for _, os in COMPANIES for o in os),
    regions={"US": (" fed ", "u.s."), "EAST": ("russia", "ukraine")},
)


def link(spark, *rows, rules=RULES):
    """Links of ``(text, title, orgs, prior)``, one list a row."""
    rows = [(i, *r, *[None] * (4 - len(r))) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "n long, text string, title string, orgs array<string>, prior string").repartition(2)
    found = entities.link_entities(docs, "n", rules, F.col("title"), F.col("text"), F.coalesce("orgs", F.array().cast("array<string>")), F.col("prior")).collect()
    return [sorted((r for r in found if r.id == i), key=lambda r: -r.relevance) for i in range(len(rows))]


def test_names_that_are_also_words(spark):
    cases = {
        "They gave chase on foot": [], "Chase opens a branch": [], "Chase shares rise": ["JPM"], "JPMorgan says Chase is growing": ["JPM"],
        "apple pie for shares of all": [], "Apple shares slip": ["AAPL"], "$AAPL and Apple": ["AAPL"], "Latest Instagram post": [], "Instagram ad revenue slows": ["META"],
        "iPhone sales slump": ["AAPL"], "Coke at the movies": [], "Coca-Cola raises prices": ["KO"], "a Coca-Cola-like drink": [], "$GOOG breaks out": ["GOOGL"],
        "Google's new phone": ["GOOGL"], "GOOG and GOOGL": ["GOOGL"], "JPM beats while BAC misses": ["JPM", "BAC"], "jpm and ba are words": [], "re-Apple shares": [], "$$BA x$BA": [], "bank of america": ["BAC"],
        "Local team wins the cup": [], "": [],
    }
    got = link(spark, *[(t,) for t in cases])
    assert [sorted(r.ticker for r in g) for g in got] == [sorted(w) for w in cases.values()]
    assert got[list(cases).index("JPMorgan says Chase is growing")][0].matched == ["JPMorgan", "Chase"]


def test_support_comes_from_the_same_part_or_the_title(spark):
    title_first, body_first, bare_here, bare_before = link(spark, ("Chase again", "JPMorgan leads"), ("JPMorgan leads", "Chase again"), ("JPM and Chase",), ("Chase", "JPM"))
    assert title_first[0].matched == ["JPMorgan", "Chase"] and body_first[0].matched == ["JPMorgan"]
    assert bare_here[0].matched == ["JPM"] and bare_before[0].matched == ["JPM", "Chase"]


def test_scores(spark):
    title, one, many, boss, name = link(
        spark, ("Alphabet is named too.", "JPMorgan beats"), ("Boeing delivers",), ("Boeing delivers; Boeing rises; Boeing and Dave Calhoun",), ("Jamie Dimon warns",), ("JPMorgan warns",)
    )
    assert [(r.ticker, r.in_title) for r in title] == [("JPM", True), ("GOOGL", False)]
    assert title[0].relevance == round(2 / 3 * (0.5 + 0.5 * 2 / 3), 4)
    assert 0 < one[0].relevance < many[0].relevance == 1.0 and boss[0].relevance == round(0.5 / 3, 4) < name[0].relevance


def test_organisations_and_priors(spark):
    orgs, inc, prior, unknown, both, nulls = link(
        spark, ("Season begins", None, ["JPMorgan  CHASE", "xinhua"]), ("x", None, ["google inc", None]), ("to the moon", None, None, "KO"), ("x", None, None, "ZZZ"), ("Boeing", None, ["boeing"], "BA"), (None, None, None, None)
    )
    assert orgs[0].ticker == "JPM" and orgs[0].matched == ["org:jpmorgan chase"] and orgs[0].relevance == round(0.5 / 3, 4)
    assert inc[0].ticker == "GOOGL" and prior[0].matched == ["prior:KO"] and unknown == [] and nulls == []
    assert both[0].matched == ["Boeing", "org:boeing", "prior:BA"] and both[0].relevance == round(2.5 / 3, 4)


def test_market_and_regions(spark):
    war, fed, company, none = link(spark, ("Russia launches invasion of Ukraine",), ("Fed raises rates", "The U.S. view"), ("Alphabet warns of inflation in Russia",), ("Russia wins the cup",))
    assert [(r.ticker, r.relevance, r.in_title, r.regions) for r in war] == [("MKT", 1.0, False, ["EAST"])]
    assert fed[0].ticker == "MKT" and fed[0].regions == ["US"] and [r.ticker for r in company] == ["GOOGL"] and company[0].regions == ["EAST"] and none == []


def test_awkward_rows(spark):
    long = "Boeing " * 20000
    a, b, c, d = link(spark, (long,), ("İİ Boeing İ", "İ"), ("Boeing\x00Boeing",), (None, ""))
    assert a[0].relevance == 1.0 and len(a[0].matched) == 20000 and b[0].matched == ["Boeing"] and c[0].matched == ["Boeing", "Boeing"] and d == []
    docs = spark.createDataFrame([(1, "Boeing"), (1, "Boeing"), (None, "Boeing")], "id long, text string").withColumn("found", F.lit(1)).withColumn("regions", F.lit(2))
    assert entities.link_entities(docs, "id", RULES, F.lit(None), F.col("text")).count() == 3
    assert entities.link_entities(docs.where("false"), "id", RULES, F.lit(None), F.col("text")).count() == 0
    empty = entities.Rules(phrases=())
    assert entities.link_entities(docs, "id", empty, F.lit(None), F.col("text")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_automaton_is_the_longest_first_pattern(seed):
    rng = random.Random(seed)
    pieces = ["a", "b", "ab", "a b", "b-a", "$a", "a b a", "B", "ba", "a.b"]
    phrases = tuple((e, k, p) for e in "XY" for k in ("strong", "ambiguous", "cashtag") for p in rng.sample(pieces, 5))
    words = entities.Automaton(phrases)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "A", "B", " ", " ", "-", "$", ".", "_", "é"]) for _ in range(30))
        want = {}
        for e in "XY":
            for k in ("strong", "ambiguous", "cashtag"):
                body = "|".join(re.escape(p) for p in sorted({p for x, y, p in phrases if (x, y) == (e, k)}, key=lambda p: (-len(p), p)))
                found = [m[0] for m in re.finditer(rf"(?<![\w\-$])(?:{body})(?![\w\-])", text, 0 if entities.KINDS[k][0] else re.I)]
                if found:
                    want[e, k] = found
        assert words.find(text) == want


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "Boeing")], "id long, text string")
    plan = entities.link_entities(docs, "id", RULES, F.lit(None), F.col("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
