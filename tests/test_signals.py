"""Signals with their evidence against a plain fold over the rows."""

import math
from collections import Counter

from quillrisk.operators import impact

H = impact.HOUR
FIELDS = "t long, seq long, ticker string, event_class string, outlet long, region string, sentiment double, relevance double, event_confidence double, severity int, raw double, story string"


def rows_of(n):
    out = []
    for i in range(n):
        t = (i * 7 // 3) * H // 20
        out.append((t, i, "AB"[i % 7 > 4], f"c{i * 5 % 3}", i % 6, None if i % 9 == 0 else f"r{i % 3}", math.sin(i), 0.5 + i % 5 / 10, 0.3 + i % 7 / 10, 1 + i % 10, (i * 37 % 11) / 11, f"s{i % 4}"))
    return out


def test_entity_signals_equal_a_fold(spark):
    rows = rows_of(300)
    want, state, recent, touched = {}, {}, {}, {}
    last_step = rows[-1][0] // H

    def emit(step):
        for k in touched.pop(step, ()):
            as_of = rows[-1][0] if step == last_step else (step + 1) * H
            num, den, at = state[k]
            best = sorted(recent[k], key=lambda r: (-r[10], r[1]))[:5]
            votes = Counter(r[3] for r in recent[k])
            want[k, step] = (as_of, num / den, 1 - math.exp(-den * 2 ** ((at - as_of) / (6 * H)) / 3), votes.most_common(1)[0][0], [r[1] for r in best], sorted({r[5] for r in recent[k]} - {None}), len({r[4] for r in recent[k]}), best[0][9])

    step = 0
    for r in rows:
        while r[0] // H > step:
            emit(step)
            step += 1
        k = r[2]
        num, den, at = state.get(k, (0.0, 0.0, r[0]))
        f, w = 2 ** ((at - r[0]) / (6 * H)), max(r[7], 1e-3) * max(r[8], 0.1)
        state[k] = (num * f + w * r[6], den * f + w, r[0])
        recent[k] = (recent.get(k, []) + [r])[-50:]
        touched.setdefault(step, {})[k] = True
    emit(step)
    got = {(r.ticker, r.step): r for r in impact.entity_signals(spark.createDataFrame(rows, FIELDS), "ticker", 0).collect()}
    assert got.keys() == want.keys()
    for k, (as_of, level, confidence, modal, evidence, regions, outlets, top) in want.items():
        r = got[k]
        assert (r.as_of, r.modal_class, r.evidence, r.regions, r.outlets, r.impact, r.top_seq) == (as_of, modal, evidence, regions, outlets, top, evidence[0])
        assert abs(r.sentiment - level) < 1e-9 and abs(r.confidence - confidence) < 1e-9


def test_event_signals_equal_a_fold(spark):
    rows = rows_of(200) + [(10**12, 900, "C", "c1", 1, None, 0.5, 1.0, 0.6, 9, 0.9, "alone")]
    got = {r.story: r for r in impact.event_signals(spark.createDataFrame(rows, FIELDS), "story", {"A": "Banks"}).collect()}
    assert got.keys() == {r[11] for r in rows}
    for story, r in got.items():
        mine = [x for x in rows if x[11] == story]
        votes = {}
        for x in mine:
            votes[x[3]] = votes.get(x[3], 0.0) + x[8]
        cls = max(votes, key=lambda c: round(votes[c], 9))
        share = votes[cls] / sum(votes.values())
        best = sorted(mine, key=lambda x: (-x[10], x[1]))[:5]
        outlets = len({x[4] for x in mine})
        assert (r.event_class, r.mentions, r.outlets, r.evidence) == (cls, len(mine), outlets, [x[1] for x in best])
        assert r.impact == min(10, best[0][9] + (2 if outlets >= 10 else 1 if outlets >= 5 else 0))
        assert r.tickers == sorted({x[2] for x in mine}) and r.sectors == (["Banks"] if "A" in r.tickers else []) and r.regions == sorted({x[5] for x in mine} - {None})
        assert r.entity == (r.tickers[0] if len(r.tickers) == 1 else None)
        assert abs(r.confidence - share * (1 - math.exp(-len(mine) / 3))) < 1e-9
        assert abs(r.event_confidence - share * max(x[8] for x in mine if x[3] == cls)) < 1e-9
    assert got["alone"].entity == "C"


def test_no_rows_no_signals(spark):
    none = spark.createDataFrame([], FIELDS)
    assert not impact.entity_signals(none, "ticker", 0).collect() and not impact.event_signals(none, "story", {}).collect()
