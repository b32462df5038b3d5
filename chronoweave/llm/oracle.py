"""SQL (DuckDB) for the operators that SQL can express on small tables."""

from __future__ import annotations

from chronoweave.llm import license_scan, mixing, setsketch, vector_dedup

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Smallest node reachable over links (a, b), for each of the nodes n.
_REACH = """
r AS (SELECT id, id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.id),
comp AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"""


def near_duplicates() -> str:
    low, most = setsketch.SIMILAR
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) >= {setsketch.WORDS} THEN list_distinct(list_transform(range(1, len(w) - {setsketch.WORDS - 2}), lambda i: array_to_string(w[i:i + {setsketch.WORDS - 1}], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT id FROM s),
g AS (SELECT id, len(s) AS k, unnest(s) AS g FROM s),
links AS (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id, x.k, y.k HAVING {most} * count(*) >= {low} * (x.k + y.k - count(*))),
{_REACH}
SELECT s.id AS doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.id = component_id AS kept FROM s JOIN comp ON comp.id = s.id"""


def near_vectors() -> str:
    return f"""
WITH RECURSIVE n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT id, e FROM n WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.id < y.id AND list_cosine_similarity(x.e, y.e) >= {vector_dedup.LEAST}),
{_REACH}
SELECT comp.id AS vec_id, (SELECT count(*) FROM links WHERE a = comp.id OR b = comp.id)::BIGINT AS n_links, component_id, comp.id = component_id AS kept FROM comp"""


def licenses() -> str:
    """The rules as in :func:`license_scan.rules`, over words that carry a mark in front and their number behind."""

    def sql(rule: str) -> str:
        # a word's mark takes the place of looking behind it
        body = rule.removeprefix("(?<= )").replace(":[0-9]++ )", ":[0-9]+ )")
        out, at = "", 0
        while at < len(body):
            end = body.find(":[0-9]+ )", at)
            if end < 0:
                out += body[at:]
                break
            begin = body.rfind("(?:", at, end)
            word = body[begin + 3 : end]
            if word.startswith("19|20)"):  # a year: its alternatives are a group of their own
                begin = body.rfind("(?:(?:", at, end)
                word = body[begin + 3 : end]
            out += body[at:begin] + "(?:\x01" + word + ":[0-9]+ )"
            at = end + len(":[0-9]+ )")
        return out.replace("'", "''")

    values = ", ".join(f"({i}, {r['p']}, '{r['l']}', '{r['k']}', '{sql(r['r'])}')" for i, r in enumerate(license_scan.rules()))
    base = sql("|".join(license_scan.compiled(phrase) for phrase, _ in license_scan.BASE).replace("(?<= )", ""))
    first = " ".join(f"WHEN '{phrase.split()[0]}' THEN '{label}'" for phrase, label in license_scan.BASE)
    gate = " OR ".join(f"contains(lower(coalesce(text, '')), '{g}')" for g in license_scan.GATES)
    ends = ", ".join(f"max(CASE WHEN p = {p} THEN e END) OVER o AS e{p}" for p in license_scan.CONFIDENCE)
    inside = " OR ".join(f"(p >= {p} AND coalesce(e{p}, -1) >= e)" for p in license_scan.CONFIDENCE)
    sure = " ".join(f"WHEN {p} THEN {c}" for p, c in license_scan.CONFIDENCE.items())
    return rf"""
WITH rules(i, p, l, k, r) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, ({gate}) AS hit FROM documents),
t AS (SELECT doc_id, array_to_string(list_transform(range(1, len(w) + 1), lambda i: chr(1) || w[i] || ':' || (i - 1) || ' '), '') AS t FROM d WHERE hit),
b AS (SELECT doc_id, unnest(regexp_extract_all(t, '{base}')) AS m FROM t),
bb AS (SELECT doc_id, regexp_extract(m, ':([0-9]+)', 1)::BIGINT AS s, CASE regexp_extract(m, '[a-z]+') {first} END AS l FROM b),
x AS (SELECT doc_id, i, p, l, unnest(regexp_extract_all(t, r)) AS m FROM t JOIN rules ON contains(t, chr(1) || k || ':')),
f AS (SELECT doc_id, i, p, l, regexp_extract(m, ':([0-9]+)', 1)::INT AS s, regexp_extract(m, ':([0-9]+) $', 1)::INT AS e FROM x),
g AS (SELECT *, {ends} FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY s, -e, p, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT doc_id, p, l FROM g WHERE NOT ({inside})),
bl AS (SELECT doc_id, count(*) AS n, min(s) AS a, max(s) AS z, list_sort(list_distinct(list(l))) AS l FROM bb GROUP BY doc_id),
kl AS (SELECT doc_id, list(DISTINCT l) AS l, min(p) AS p FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a AS first_word, z AS last_word, coalesce(array_to_string(bl.l, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl.l, []), coalesce(kl.l, [])))), ','), '') AS labels,
       greatest(coalesce(CASE kl.p {sure} END, 0.0), CASE WHEN n > 0 THEN 0.7 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN bl ON bl.doc_id = d.doc_id LEFT JOIN kl ON kl.doc_id = d.doc_id"""


def all_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses(), "op6_mixing": mixing.SQL, "op9_near_duplicates": near_duplicates(), "op10_near_vectors": near_vectors()}
