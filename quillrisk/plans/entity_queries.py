"""Entity links over the documents, with the same rules as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrisk.operators import entities
from quillrisk.plans import models as M
from quillrisk.plans.queries import query

#: Rules for the made-up prose: frequent words and runs of words stand for companies, their people and brands.
_COMPANIES = [
    entities.company("EN", "en holdings", ["of the", "the", "that is"], ambiguous=("The", "This"), brands=("by", "with the"), execs=("and the", "to be"), cashtags=("$EN",), bare=("Of", "In")),
    entities.company("DE", "source1", ["der", "und der", "in der"], ambiguous=("Die", "Das"), brands=("sich",), execs=("von der", "mit der"), cashtags=("$DE",), bare=("Und",)),
    entities.company("ES", "source2", ["de la", "los", "en el"], ambiguous=("La", "Los"), brands=("que",), execs=("de los",), cashtags=("$ES",), bare=("Con",)),
    entities.company("FR", "source3", ["les", "de la", "dans le"], ambiguous=("Le", "Les"), brands=("une",), execs=("et les",), cashtags=("$FR",), bare=("Pour",)),
]
RULES = entities.Rules(
    phrases=tuple(p for phrases, _ in _COMPANIES for p in phrases) + tuple(("", "context", w) for w in ("for", "was", "mit dem", "con", "par")) + tuple(("", "market", w) for w in ("ist", "es", "is")),
    orgs=tuple(o for _, orgs in _COMPANIES for o in orgs),
    regions={"NORTH": (" with ", " on "), "SOUTH": ("ment ", " por "), "EAST": (" nicht ", "lich ")},
)
TITLE, BODY = r"^[^.\n]*", r"(?s)^[^.\n]*(.*)$"


def _list_sql(entity: str, kind: str, part: str) -> str:
    """The terms of a kind in a part as SQL: characters that part words are doubled, so that neighbours do not share one."""
    words = sorted({p for e, k, p in RULES.phrases if (e, k) == (entity, kind)}, key=lambda p: (-len(p), p))
    if not words:
        return "CAST([] AS VARCHAR[])"
    quoted = "|".join(w.replace("$", r"\$").replace(" ", "  ") for w in words)
    flags = "" if entities.KINDS[kind][0] else "(?i)"
    return rf"list_transform(regexp_extract_all({part}_wide, '{flags}(?:^|[^\p{{L}}\p{{N}}_$-])({quoted})(?:$|[^\p{{L}}\p{{N}}_-])', 1), lambda x: replace(x, '  ', ' '))"


def links_sql(with_prior: bool = True) -> str:
    """The links as SQL; ``with_prior``: the language of a document stands for the entity that its source names."""
    kinds = [k for k in entities.KINDS if k not in entities.SHARED]
    lists = ", ".join(f"{_list_sql(e, k, p)} AS {e}_{k}_{p}" for e in RULES.entities for k in kinds for p in ("title", "body"))
    shared = ", ".join(f"len({_list_sql('', k, 'title')}) + len({_list_sql('', k, 'body')}) > 0 AS {k}" for k in entities.SHARED)
    regions = ", ".join(f"CASE WHEN {' OR '.join(f'contains(padded, {chr(39)}{p}{chr(39)})' for p in parts)} THEN '{r}' END" for r, parts in RULES.regions.items())
    rows = []
    for e in RULES.entities:
        n = lambda p, *ks: " + ".join(f"len({e}_{k}_{p})" for k in ks)  # noqa: B023, E731
        sure_title = f"({n('title', 'cashtag', 'strong', 'exec')}) > 0"
        sure_body = f"({n('body', 'cashtag', 'strong', 'exec')} + {n('title', 'cashtag', 'strong', 'exec', 'bare')}) > 0"
        parts, score, in_title = [], [], []
        for p, sure in (("title", sure_title), ("body", sure_body)):
            for k in kinds:
                terms = f"CASE WHEN context OR {sure} THEN {e}_{k}_{p} ELSE [] END" if entities.KINDS[k][1] else f"{e}_{k}_{p}"
                parts.append(terms)
                score.append(f"{entities.KINDS[k][2] * (RULES.title_weight if p == 'title' else 1)} * len({terms})")
                if p == "title":
                    in_title.append(f"len({terms})")
        orgs = ", ".join(f"'{o}'" for x, o in RULES.orgs if x == e)
        parts += [f"CASE WHEN org IN ({orgs}) THEN ['org:' || org] ELSE [] END", f"CASE WHEN prior = '{e}' THEN ['prior:{e}'] ELSE [] END"]
        score += [f"CASE WHEN org IN ({orgs}) THEN {RULES.org_weight} ELSE 0 END", f"CASE WHEN prior = '{e}' THEN {RULES.prior_weight} ELSE 0 END"]
        rows.append(f"SELECT r, doc_id, '{e}' AS ticker, CAST({' + '.join(score)} AS DOUBLE) AS score, {' + '.join(in_title)} > 0 AS in_title, flatten([{', '.join(parts)}]) AS matched, regions FROM hits")
    return rf"""WITH parts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract(text, '^[^.\n]*'), '') AS title, coalesce(regexp_extract(text, '(?s)^[^.\n]*(.*)$', 1), '') AS body, source AS org, {'upper(lang)' if with_prior else 'CAST(NULL AS VARCHAR)'} AS prior FROM documents
), wide AS (
  SELECT *, ' ' || trim(regexp_replace(lower(title || ' ' || body), '[^0-9a-z&$.+''\-]+', ' ', 'g')) || ' ' AS padded,
    regexp_replace(title, '([^\p{{L}}\p{{N}}_$-])', '\1\1', 'g') AS title_wide, regexp_replace(body, '([^\p{{L}}\p{{N}}_$-])', '\1\1', 'g') AS body_wide FROM parts
), hits AS (SELECT r, doc_id, trim(regexp_replace(lower(org), '[^0-9a-z&$.+''\-]+', ' ', 'g')) AS org, prior, {shared}, list_filter([{regions}], lambda x: x IS NOT NULL) AS regions, {lists} FROM wide
), linked AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE score > 0)
SELECT doc_id AS id, ticker, round(least(1.0::DOUBLE, score / 3.0::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * (score / sum(score) OVER (PARTITION BY r))), 4) AS relevance, in_title, array_to_string(matched, '|') AS matched, array_to_string(regions, '|') AS regions FROM linked
UNION ALL SELECT doc_id, 'MKT', 1.0::DOUBLE, false, 'mkt', array_to_string(regions, '|') FROM hits WHERE market AND r NOT IN (SELECT r FROM linked)"""


def links(spark, d, with_prior: bool = True):
    docs, text = M.documents(spark, d), F.coalesce("text", F.lit(""))
    title, body = F.regexp_extract(text, TITLE, 0), F.regexp_extract(text, BODY, 1)
    found = entities.link_entities(docs, "doc_id", RULES, title, body, F.array("source"), F.upper("lang") if with_prior else None)
    return found.withColumn("matched", F.array_join("matched", "|")).withColumn("regions", F.array_join("regions", "|"))


@query(links_sql())
def d1_link_entities(spark, d):
    return links(spark, d)
