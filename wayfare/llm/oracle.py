"""DuckDB SQL for the queries that SQL can say."""

from __future__ import annotations

import math

from . import quality

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh
  AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), both_ways AS (SELECT a, b FROM e
  UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.m), k AS (SELECT d,
  min(m) AS m FROM r GROUP BY d)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, k.m AS component_id, k.m = documents.doc_id AS kept FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN k ON k.d = documents.doc_id"""


def _base32() -> str:
    groups = [f"CAST('0x' || substr(h, {1 + 5 * g}, 5) AS INTEGER)" for g in range(8)]
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({v} >> {5 * k}) % 32 + 1, 1)" for v in groups for k in (3, 2, 1, 0))


WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h AS g, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_base32()} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p JOIN f ON f.g = p.h"""


def _quality() -> str:
    rules = {
        "symbols_per_word": "n_symbols / CAST(n_words AS DOUBLE)", "dup_lines_per_100_words": "100e0 * n_dup_lines / n_words", "repeat_word_share": "n_repeat_words / CAST(n_words AS DOUBLE)",
        "long_words": "word_chars / CAST(n_words AS DOUBLE)", "short_words": "-(word_chars / CAST(n_words AS DOUBLE))",
    }
    p, share = quality.ALPHA, quality.DELTA
    grid = " UNION ALL ".join(
        f"SELECT '{r}' AS rule, {k} AS pos, {float(c)!r}e0 AS cutoff" for r, cuts in quality.CUTOFFS.items() for k, c in enumerate(cuts)
    )
    values = " UNION ALL ".join(f"SELECT rid, quality, stratum, '{r}' AS rule, {v} AS v FROM held" for r, v in rules.items())
    tail = f"""list_sum(list_transform(range(0, n_rejected + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1)
 + j * {math.log(p)!r} + (n_good - j) * {math.log1p(-p)!r})))"""
    hits = ", ".join(f"CASE WHEN {v} >= max(CASE WHEN rule = '{r}' THEN cutoff END) THEN '{r}' END" for r, v in rules.items())
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"
    return f"""WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT rid, i, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t
  WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1), rep AS (SELECT rid, count(*) AS n
  FROM (SELECT DISTINCT rid, i + k AS at FROM twice, range(0, 3) q(k)) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{WORD}')
  GROUP BY rid),
f0 AS (SELECT t.rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n,
  0) AS n_repeat_words FROM t LEFT JOIN ln ON ln.rid = t.rid LEFT JOIN rep ON rep.rid = t.rid),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f0),
q AS (SELECT doc_id AS id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT f.*, q.quality FROM f LEFT JOIN q ON q.id = f.doc_id WHERE NOT base_failed), grid AS ({grid}), vals AS ({values}),
totals AS (SELECT stratum AS s, count(*) FILTER (WHERE quality <> 1) AS all_bad, count(*) FILTER (WHERE quality IS NULL) AS all_none FROM held
  GROUP BY stratum),
caught AS (SELECT stratum, vals.rule, pos, cutoff, count(*) FILTER (WHERE quality <> 1) AS bad, count(*) FILTER (WHERE quality IS NULL) AS none_
 FROM vals JOIN grid ON grid.rule = vals.rule AND v >= cutoff GROUP BY stratum, vals.rule, pos, cutoff),
path AS (SELECT stratum, rule, pos, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY none_, pos DESC, bad DESC, rule) AS step
 FROM caught JOIN totals ON s IS NOT DISTINCT FROM stratum WHERE bad > 0 AND bad * all_none >= {quality.ENRICH} * none_ * all_bad),
sized AS (SELECT stratum, n_good, row_number() OVER (ORDER BY n_good DESC, stratum NULLS FIRST) AS rank FROM (SELECT stratum, count(*) AS n_good
  FROM held WHERE quality = 1 GROUP BY stratum)),
few AS (SELECT max(rank) AS strata FROM sized WHERE n_good * {math.log1p(-p)!r} <= ln({share!r} / rank)), tested AS (SELECT stratum, n_good, strata
  FROM sized, few WHERE rank <= strata),
hit AS (SELECT s, step0, count(*) AS c FROM (SELECT rid, any_value(vals.stratum) AS s, min(step) AS step0 FROM vals
  JOIN path ON path.stratum IS NOT DISTINCT FROM vals.stratum
 AND path.rule = vals.rule AND v >= cutoff WHERE quality = 1 GROUP BY rid) GROUP BY s, step0),
x AS (SELECT path.*, n_good, strata, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY path.stratum ORDER BY step) AS BIGINT) AS n_rejected
 FROM path JOIN tested ON tested.stratum IS NOT DISTINCT FROM path.stratum LEFT JOIN hit ON s IS NOT DISTINCT FROM path.stratum AND step0 = step),
ok AS (SELECT *, n_rejected < n_good * {p!r} AND {tail} <= {share!r} / strata AS ok FROM x),
best AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY stratum
  ORDER BY step) AS all_ok FROM ok)
 WHERE all_ok = 1 GROUP BY stratum, rule),
j AS (SELECT {columns}, list_filter([{hits}], lambda h: h IS NOT NULL) AS rejected_by FROM f LEFT JOIN best ON best.stratum IS NOT DISTINCT
  FROM f.stratum GROUP BY rid, {columns})
SELECT {columns}, NOT base_failed AND len(rejected_by) = 0 AS kept, array_to_string(rejected_by, ',') AS rejected_by FROM j"""


AUDIT = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '{WORD}')) AS w FROM t), n AS (SELECT rid, count(*) AS n, count(DISTINCT w) AS d FROM w GROUP BY rid),
same AS (SELECT t AS text, min(doc_id) AS first FROM t GROUP BY t),
l AS (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {{'A': coalesce(n, 0) < 200, 'B': 100 * coalesce(d, 0) < 50 * coalesce(n, 0),
  'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
  'E': coalesce(doc_id > first, false)}} AS f FROM t LEFT JOIN n ON n.rid = t.rid JOIN same ON same.text = t.t LEFT JOIN l ON l.id = t.doc_id),
c AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D
  ELSE f.E END) AS fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS BIGINT), 1) AS own,
  string_split(substr(filter_order, 1, CAST(step AS BIGINT) - 1), '') AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE NOT list_contains(fails, own) AND NOT list_has_any(fails, before)) AS kept,
  sum(n) FILTER (WHERE list_contains(fails, own) AND NOT list_has_any(fails, before)) AS removed,
  sum(n) FILTER (WHERE list_contains(fails, own) AND list_has_any(fails, before)) AS redundant, sum(n) FILTER (WHERE fails = [own]) AS unique_fails,
  sum(n) FILTER (WHERE good AND list_contains(fails, own) AND NOT list_has_any(fails, before)) AS good_lost,
  sum(n) FILTER (WHERE toxic AND list_contains(fails, own) AND NOT list_has_any(fails, before)) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT)
  AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS t
  FROM benchmark) GROUP BY item_id, t),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d)
  GROUP BY rid, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY t, docs),
x AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN p ON p.t = q.t JOIN f ON f.t = q.t, s GROUP BY item_id, rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id
  ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 20"""


def oracles() -> dict[str, str]:
    return {"op3_quality_rules": _quality(), "op7_warc": WARC, "op10_near_duplicates": NEAR, "op12_ranked_search": SEARCH, "op13_filter_audit": AUDIT}
