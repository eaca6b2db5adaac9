"""Entity links by one pass of a multi-pattern automaton over every text.

Phrases of all kinds are in one table. The automaton of the table goes to the tasks once; a text is read once, whatever the number of phrases, and
no word of it is shuffled. What it finds is a small array beside the row, from which links are scored by column expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrisk.functions.text import once

#: Kinds of phrases: whether case counts, whether a phrase needs support to count, and its weight.
KINDS = {
    "cashtag": (False, False, 1.0),
    "strong": (False, False, 1.0),
    "exec": (False, False, 0.5),
    "ambiguous": (True, True, 1.0),
    "brand": (False, True, 1.0),
    "bare": (True, False, 1.0),
    "context": (False, False, 0.0),
    "market": (False, False, 0.0),
}
#: Kinds that belong to no entity; their phrases stand under the empty name.
SHARED = ("context", "market")
MARKET = "MKT"
#: What is found, together by part, kind and entity: ``sure`` needs no support, ``points`` is the weight of all the terms.
FOUND = "array<struct<entity:string,kind:string,title:boolean,sure:boolean,points:double,terms:array<string>>>"


@dataclass(frozen=True)
class Rules:
    """``phrases``: ``(entity, kind, phrase)``; ``orgs``: ``(entity, organisation)`` in plain form; ``regions``: padded parts of the plain text by region."""

    phrases: tuple[tuple[str, str, str], ...]
    orgs: tuple[tuple[str, str], ...] = ()
    regions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    title_weight: float = 2.0
    org_weight: float = 0.5
    prior_weight: float = 1.0
    cap: float = 3.0

    @property
    def entities(self) -> list[str]:
        return sorted({e for e, k, _ in self.phrases if k not in SHARED} | {e for e, _ in self.orgs})


def company(entity: str, name: str, aliases: list[str], ambiguous: tuple[str, ...] = (), brands: tuple[str, ...] = (), execs: tuple[str, ...] = (), cashtags: tuple[str, ...] = (), bare: tuple[str, ...] = ()) -> tuple[list, list]:
    """``(phrases, orgs)`` of one company; an ambiguous alias is neither a strong alias nor a brand."""
    kinds = {"cashtag": cashtags, "strong": [a for a in aliases if a not in ambiguous], "exec": execs, "ambiguous": ambiguous, "brand": [b for b in brands if b not in ambiguous], "bare": bare}
    names = {" ".join(a.lower().split()) for a in aliases}
    orgs = names | {f"{n} inc" for n in names} | {name.lower()}
    return [(entity, k, p) for k, ps in kinds.items() for p in ps], [(entity, o) for o in sorted(orgs)]


def plain(text: Column) -> Column:
    """Lower case, runs of other than letters, digits and ``& $ . + ' -`` as one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z&$.+'\-]+", " ")), F.lit(" "))


def _lower(text: str) -> str:
    """Lower case that keeps every letter's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Automaton:
    """Whole phrases of all kinds: at every place the longest of an entity and kind, then on after its end."""

    def __init__(self, phrases: tuple[tuple[str, str, str], ...]) -> None:
        self.words, owners = ahocorasick.Automaton(), {}
        for entity, kind, phrase in sorted(set(phrases)):
            if phrase:
                owners.setdefault(_lower(phrase), []).append((entity, kind, phrase if KINDS[kind][0] else None))
        for phrase, of in owners.items():
            self.words.add_word(phrase, (len(phrase), of))
        if owners:
            self.words.make_automaton()
        self.any = bool(owners)

    def find(self, text: str | None) -> dict[tuple[str, str], list[str]]:
        """Terms of each entity and kind, in the order of places."""
        if not text or not self.any:
            return {}
        by_owner: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for last, (size, of) in self.words.iter(_lower(text)):
            lo, hi = last + 1 - size, last + 1
            if lo and (text[lo - 1].isalnum() or text[lo - 1] in "_-$") or hi < len(text) and (text[hi].isalnum() or text[hi] in "_-"):
                continue
            for entity, kind, exact in of:
                if exact is None or exact == text[lo:hi]:
                    by_owner.setdefault((entity, kind), []).append((lo, -hi))
        out = {}
        for owner, spans in by_owner.items():
            end, terms = 0, []
            for lo, hi in sorted(spans):
                if lo >= end:
                    end = -hi
                    terms.append(text[lo:end])
            out[owner] = terms
        return out


def found(title: Column, text: Column, rules: Rules) -> Column:
    """All phrases of a title and a text, as an array: the automaton reads Arrow batches."""
    phrases, order, times = rules.phrases, list(KINDS), {True: rules.title_weight, False: 1.0}

    @F.pandas_udf(FOUND)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        words = Automaton(phrases)

        def parts(text: str | None, title: bool) -> list[tuple]:
            ordered = sorted(words.find(text).items(), key=lambda x: (order.index(x[0][1]), x[0][0]))
            return [(entity, kind, title, not KINDS[kind][1], KINDS[kind][2] * times[title] * len(terms), terms) for (entity, kind), terms in ordered]

        for titles, texts in batches:
            yield pd.Series([parts(a, True) + parts(b, False) for a, b in zip(titles, texts)], index=titles.index)

    return read(title.cast("string"), text.cast("string"))


def link_entities(docs: DataFrame, id_col: str, rules: Rules, title: Column, text: Column, orgs: Column | None = None, prior: Column | None = None) -> DataFrame:
    """``(id, ticker, relevance, in_title, matched, regions)``, a row for each document and entity it is linked to.

    Phrases count by their kind's weight, in the title ``title_weight`` times. An ambiguous alias or a brand counts only if a context word is in the title
    or the text, or a phrase of the entity that is not ambiguous in the same part or the title. ``orgs`` (an array of names) and ``prior`` (an
    entity that the source names) add to the score. Relevance is ``min(1, score / cap) * (0.5 + 0.5 * share of all scores)`` to four places. A
    document without entities but with a market phrase goes to ``MKT`` whole. Null and empty titles and texts hold nothing; a null prior or organisation is
    none; documents without links have no row; repeated rows are linked each; other columns are not read.
    """
    orgs = F.array().cast("array<string>") if orgs is None else orgs
    prior = F.lit(None).cast("string") if prior is None else prior
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    regions = once(plain(whole), lambda p: F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(_any_of(p, parts), F.lit(r)) for r, parts in rules.regions.items()])))
    named = F.array_distinct(F.transform(F.filter(orgs, lambda o: o.isNotNull()), lambda o: F.trim(plain(o))))
    base = docs.select(F.col(id_col).alias("id"), title.alias("title"), text.alias("text"), named.alias("orgs"), prior.alias("prior"), regions.alias("regions"))
    rows = base.select("id", found(F.col("title"), F.col("text"), rules).alias("found"), "orgs", "prior", "regions")

    own = F.array(*[F.lit(e) for e in rules.entities]).cast("array<string>")
    known = [F.struct(F.lit(e).alias("entity"), F.lit(o).alias("org")) for e, o in sorted(set(rules.orgs)) or [("", "")]]
    by_org = F.filter(F.array(*known), lambda x: F.array_contains("orgs", x["org"]))
    rows = rows.select(
        "id", "found", "regions", by_org.alias("orgs"),
        F.when(F.array_contains(own, F.col("prior")), F.col("prior")).alias("prior"),
        F.exists("found", lambda f: f["kind"] == "context").alias("context"),
        F.exists("found", lambda f: f["kind"] == "market").alias("market"),
    )
    phrases = F.filter("found", lambda f: ~f["kind"].isin(*SHARED))
    names = F.array_distinct(F.array_union(F.array_union(F.transform(phrases, lambda f: f["entity"]), F.transform("orgs", lambda o: o["entity"])), F.array_compact(F.array("prior"))))

    # Bare names are read after the other kinds of a part, so they support the parts after theirs only.
    supports = lambda x, f: f["sure"] & ((f["title"] & ~x["title"]) | ((f["title"] == x["title"]) & (f["kind"] != "bare")))

    def scored(name: Column) -> Column:
        mine = F.filter("found", lambda f: f["entity"] == name)
        held = F.filter(mine, lambda x: x["sure"] | F.col("context") | F.exists(mine, lambda f: supports(x, f)))
        own_orgs, is_prior = F.filter("orgs", lambda o: o["entity"] == name), F.coalesce(F.col("prior") == name, F.lit(False))
        score = F.aggregate(held, F.lit(0.0), lambda s, x: s + x["points"]) + rules.org_weight * F.size(own_orgs) + F.when(is_prior, rules.prior_weight).otherwise(0.0)
        none = F.array().cast("array<string>")
        terms = F.concat(F.flatten(F.transform(held, lambda x: x["terms"])), F.transform(own_orgs, lambda o: F.concat(F.lit("org:"), o["org"])), F.when(is_prior, F.array(F.concat(F.lit("prior:"), name))).otherwise(none))
        return F.struct(name.alias("ticker"), score.alias("score"), F.exists(held, lambda x: x["title"]).alias("in_title"), terms.alias("matched"))

    rows = rows.select("id", "regions", "market", F.filter(F.transform(names, scored), lambda s: s["score"] > 0).alias("linked"))
    total = F.aggregate("linked", F.lit(0.0), lambda s, x: s + x["score"])
    market = F.when(F.col("market"), F.array(F.struct(F.lit(MARKET).alias("ticker"), F.lit(1.0).alias("relevance"), F.lit(False).alias("in_title"), F.array(F.lit("mkt")).alias("matched"))))
    relevance = lambda x: F.round(F.least(F.lit(1.0), x["score"] / rules.cap) * (0.5 + 0.5 * (x["score"] / total)), 4)
    links = F.transform("linked", lambda x: F.struct(x["ticker"].alias("ticker"), relevance(x).alias("relevance"), x["in_title"].alias("in_title"), x["matched"].alias("matched")))
    return rows.select("id", "regions", F.when(F.size("linked") > 0, links).otherwise(market).alias("links")).select("id", F.inline_outer("links"), "regions").where("ticker IS NOT NULL")  # a plain inline would be tested below the automaton, which would run twice


def _any_of(padded: Column, parts: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(padded, F.lit(x)) for x in parts], F.lit(False))
