"""SQL for a second engine that gives the rows of those operators' queries that SQL can state."""

from __future__ import annotations

from tessera.llm import quality_rules
from tessera.llm.revisits import PERMITTED

#: Linked with what: (a, b) pairs to (node, component), the smallest node reachable.
_REACH = "l AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r(v, c) USING KEY (v) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, min(r.c) FROM r JOIN l ON r.v = l.a JOIN recurring.r x ON x.v = l.b WHERE r.c < x.c GROUP BY l.b)"

EMBEDDING_DEDUP = f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  e1 AS (SELECT vec_id, v, len(v) AS dim FROM e WHERE len(v) > 0 AND NOT list_contains(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x)), TRUE) AND list_sum(list_transform(v, lambda x: abs(x))) > 0),
  links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e1 p JOIN e1 q ON p.vec_id < q.vec_id AND p.dim = q.dim WHERE list_cosine_similarity(p.v, q.v) >= 0.95), {_REACH},
  d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
  SELECT vec_id, coalesce(d.n, 0) AS n_links, coalesce(r.c, vec_id) AS component_id, vec_id = coalesce(r.c, vec_id) AS kept FROM e LEFT JOIN d ON d.a = vec_id LEFT JOIN r ON r.v = vec_id"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
  x AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
  k AS (SELECT p.doc_id AS a, q.doc_id AS b, p.n + q.n AS n, count(*) AS i FROM x p JOIN x q ON p.h = q.h AND p.doc_id < q.doc_id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY ALL),
  links AS (SELECT a, b FROM k WHERE 100 * i >= 80 * (n - i)), {_REACH}
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(r.c, doc_id) AS component_id, doc_id = coalesce(r.c, doc_id) AS kept FROM s LEFT JOIN r ON r.v = doc_id"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    return f"""WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS given, rest FROM p),
  u AS (SELECT page_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(given) + 1), '^[^?#]*') AS path FROM q),
  r AS (SELECT * FROM (VALUES {values}) t(verdict, h, x)),
  f AS (SELECT page_id, host, path, (SELECT arg_max({{'rule': h || x, 'verdict': verdict}}, length(h || x)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x)) AS best FROM u)
  SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM f"""


_PERMITTED = ", ".join(f"'{h}'" for h in PERMITTED)
REVISITS = f"""WITH p AS (SELECT *, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) AS INTEGER) AS k, '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day ' || CAST(page_id // 1000 AS VARCHAR) AS day FROM pages),
  f AS (SELECT page_id * 2 AS record_id, url, page_id AS t, 'response' AS kind, html AS payload, [struct_pack(k := 'etag', v := tag), struct_pack(k := 'last-modified', v := day), struct_pack(k := 'date', v := day), struct_pack(k := 'content-length', v := CAST(length(html) AS VARCHAR))] AS headers FROM p),
  a AS (SELECT page_id * 2 + 1 AS record_id, regexp_replace(url, '#.*$', '') || '#again' AS url, page_id + 10000 AS t, 'revisit' AS kind, CAST(NULL AS VARCHAR) AS payload,
    [struct_pack(k := 'etag', v := CASE WHEN k % 5 = 0 THEN '"older"' WHEN k % 5 < 3 THEN 'W/' || tag END), struct_pack(k := 'last-modified', v := CASE WHEN k % 5 = 3 THEN day END), struct_pack(k := 'date', v := day || ' and later'), struct_pack(k := 'cache-control', v := 'max-age=60'), struct_pack(k := 'set-cookie', v := 'not permitted')] AS headers FROM p WHERE k % 3 = 0),
  b AS (SELECT record_id, url, t, kind, payload, list_filter(headers, lambda h: h.v IS NOT NULL) AS headers FROM (FROM f UNION ALL FROM a)),
  c AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM b),
  d AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$'))) AS query FROM c),
  n AS (SELECT *, lower(regexp_replace(regexp_extract(rest, '^[^/?]*'), ':(80|443)$', '')) || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical_url,
    regexp_replace(list_filter(headers, lambda h: h.k = 'etag')[1].v, '^W/', '') AS etag, list_filter(headers, lambda h: h.k = 'last-modified')[1].v AS modified FROM d),
  m AS (SELECT *, last_value(CASE WHEN kind = 'response' AND payload IS NOT NULL THEN struct_pack(record_id := record_id, etag := etag, modified := modified, headers := headers, payload := payload) END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM n),
  v AS (SELECT *, CASE WHEN kind = 'revisit' THEN CASE WHEN r IS NULL OR canonical_url IS NULL THEN 'no_response' WHEN etag IS NOT NULL AND r.etag IS NOT NULL THEN CASE WHEN etag = r.etag THEN 'resolved' ELSE 'mismatch' END
    WHEN etag IS NULL AND modified IS NOT NULL AND r.modified IS NOT NULL THEN CASE WHEN modified = r.modified THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END END AS verdict FROM m),
  o AS (SELECT *, CASE WHEN verdict = 'resolved' THEN r.payload ELSE payload END AS body, CASE WHEN verdict = 'resolved' THEN list_filter(headers, lambda h: h.k IN ({_PERMITTED})) ELSE headers END AS own FROM v),
  h AS (SELECT *, list_concat(own, CASE WHEN verdict = 'resolved' THEN list_filter(r.headers, lambda h: NOT list_contains(list_transform(own, lambda g: g.k), h.k)) ELSE [] END) AS merged FROM o)
  SELECT record_id, canonical_url, kind, verdict, CASE WHEN verdict = 'resolved' THEN r.record_id END AS response_id, md5(coalesce(body, '')) AS payload_md5, md5(array_to_string(list_sort(list_transform(merged, lambda h: h.k || '=' || h.v)), chr(10))) AS headers_md5 FROM h"""


def quality_rules_sql() -> str:
    """References, histograms and distances as lists."""
    r = quality_rules
    part = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ({m})) ELSE 0 END"
    term = f"({part('z[1]', '(z[1] + z[2]) / 2')} + {part('z[2]', '(z[1] + z[2]) / 2')}) / 2"
    distance = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {term})), 0))"
    with_rest = lambda p: f"list_append({p}, 1 - list_sum({p}))"
    classes = {"lower": "letters - upper", "upper": "upper", "number": "number", "space": "chars - word_chars", "punct": "punct", "sign": "chars - letters - number - punct - (chars - word_chars)"}
    return rf"""WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
  g AS (SELECT *, CASE WHEN len(w) < 8 THEN [] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END AS g, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM a),
  y AS (SELECT row_number() OVER () AS id, * FROM g), z AS (SELECT id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM y),
  rep AS (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS j FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM z) q WHERE c > 1), cov AS (SELECT id, sum(least(8, coalesce(j - i, 8))) AS n FROM rep GROUP BY id),
  b AS (SELECT doc_id, lang, w, len(w) AS n, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars,
    length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^\p{{N}}]+', '', 'g')) AS number, length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) AS punct FROM y LEFT JOIN cov USING (id)),
  good AS (SELECT * FROM b WHERE lang IS NOT NULL AND doc_id IN (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) q ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {r.SAMPLE_ROWS})),
  sums AS (SELECT lang, sum(n) AS n, sum(chars) AS chars, [{", ".join(f"sum({c})" for c in classes.values())}] AS c FROM good GROUP BY lang HAVING sum(n) >= {r.MIN_REFERENCE_WORDS}),
  each AS (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(w) AS w FROM good) q WHERE regexp_matches(w, '^\p{{L}}+$') GROUP BY ALL),
  top AS (SELECT lang, w, c, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS k FROM each QUALIFY k <= {r.COMMON_WORDS}),
  ref AS (SELECT lang, list(w ORDER BY k) AS ws, list(top.c / sums.n ORDER BY k) AS shares, list_transform(any_value(sums.c), lambda x: x / any_value(chars)) AS cs FROM top JOIN sums USING (lang) GROUP BY lang),
  lim AS (SELECT *, {with_rest("shares")} AS q, {distance("list_append(list_transform(shares, lambda x: 0.0), 1.0)", with_rest("shares"))} AS without FROM ref),
  c AS (SELECT b.*, n < 20 OR 100 * n_repeat_words > 30 * n AS base_failed, without, CASE WHEN chars >= {r.MIN_CHARS} AND cs IS NOT NULL THEN {distance("[" + ", ".join(f"({c}) / chars" for c in classes.values()) + "]", "cs")} END AS class_distance,
    CASE WHEN n >= {r.MIN_WORDS} AND ws IS NOT NULL THEN {distance(with_rest("list_transform(ws, lambda x: len(list_filter(w, lambda y: y = x)) / n)"), "q")} END AS word_distance FROM b LEFT JOIN lim USING (lang))
  SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, round(class_distance, 9) AS class_distance, round(word_distance, 9) AS word_distance,
    NOT base_failed AND coalesce(class_distance, 0) <= {r.MAX_CLASS_DISTANCE} AND coalesce(word_distance <= {r.WORD_LIMIT} * without, TRUE) AS kept FROM c"""
