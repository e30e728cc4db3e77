"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations


# Beta-binomial weights by moments, then host, domain and suffix means, each shrunk to the one above.
def _weight(level: str, k: str, n: str) -> str:
    return f"""(
  SELECT CASE WHEN g < 2 OR p IS NULL THEN 10.0::DOUBLE
              WHEN n::DOUBLE - nn::DOUBLE / n::DOUBLE <= 0 OR p * (1.0::DOUBLE - p) <= 0 THEN 10.0::DOUBLE
              ELSE (SELECT CASE WHEN b <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, p * (1.0::DOUBLE - p) / b - 1.0::DOUBLE)) END
                    FROM (SELECT (kk::DOUBLE / 1000000.0::DOUBLE - k::DOUBLE * p - (g::DOUBLE - 1.0::DOUBLE) * (p * (1.0::DOUBLE - p))) / (n::DOUBLE - nn::DOUBLE / n::DOUBLE) AS b)) END
  FROM (SELECT *, k::DOUBLE / n::DOUBLE AS p
        FROM (SELECT count(*) AS g, sum({n})::BIGINT AS n, sum({k})::BIGINT AS k, sum({n} * {n})::BIGINT AS nn, sum(({k} * {k} * 1000000) // {n})::BIGINT AS kk
              FROM {level} WHERE {n} >= 2)))"""


OP5 = rf"""
WITH urls AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
outcomes AS (SELECT doc_id AS page_id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(good)::BIGINT AS n, coalesce(sum(good), 0)::BIGINT AS k,
                 array_to_string(string_split(host, '.')[-2:], '.') AS domain, array_to_string(string_split(host, '.')[-1:], '.') AS suffix
          FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS dn, sum(k)::BIGINT AS dk FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(dn)::BIGINT AS sn, sum(dk)::BIGINT AS sk FROM domains GROUP BY 1),
overall AS (SELECT (sum(sk) + 1)::DOUBLE / (sum(sn) + 2)::DOUBLE AS o FROM suffixes),
w AS (SELECT {_weight("suffixes", "sk", "sn")} AS ws, {_weight("domains", "dk", "dn")} AS wd, {_weight("hosts", "k", "n")} AS wh),
s AS (SELECT suffix, (sk::DOUBLE + ws * o) / (sn::DOUBLE + ws) AS sm FROM suffixes, overall, w),
d AS (SELECT domain, (dk::DOUBLE + wd * sm) / (dn::DOUBLE + wd) AS dm FROM domains JOIN s USING (suffix), w),
h AS (SELECT host, (k::DOUBLE + wh * dm) / (n::DOUBLE + wh) AS m, n, wh FROM hosts JOIN d USING (domain), w),
b AS (SELECT host, greatest(0.0::DOUBLE, m - 1.0::DOUBLE * sqrt(m * (1.0::DOUBLE - m) / (n::DOUBLE + (wh + 1.0::DOUBLE)))) AS bound FROM h),
judged AS (
  SELECT page_id, host, path, bound,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM urls JOIN b USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 0.4 THEN 'allow' ELSE 'block' END AS verdict
FROM judged
"""

OP9 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP10 = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, len(list_slice(w, i, i + 12)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lens)),
hits AS (SELECT doc_id, i, n, item_id FROM spots JOIN wins USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# Every 200-byte string of every text, the ones that start at several places, and the bytes they cover.
OP2 = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
grams AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM t WHERE n >= 200)),
twice AS (SELECT h FROM grams GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS q
        FROM grams WHERE h IN (SELECT h FROM twice)),
runs AS (SELECT doc_id, i AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit WHERE p IS NULL OR i > p + 200),
ends AS (SELECT doc_id, i + 200 AS z, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit WHERE q IS NULL OR q > i + 200),
spans AS (SELECT doc_id, a, z, k FROM runs JOIN ends USING (doc_id, k)),
gaps AS (SELECT doc_id, k, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 1) AS s, a AS e FROM spans
         UNION ALL SELECT doc_id, max(k) + 1, max(z), any_value(n) + 1 FROM spans JOIN t USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN e > s THEN hex(b[s:e - 1]) ELSE '' END, '' ORDER BY k) AS body FROM gaps JOIN t USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(body) END) AS kept_sha256
FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y USING (g) JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
          WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
OP11 = OP6.replace("i + 2)", "i + 4)").replace("len(w) - 2", "len(w) - 4").replace(">= 90 *", ">= 85 *")
OP11 = OP11.replace("min(root) AS component_id FROM", "min(root) AS component_id, doc_id = min(root) AS kept FROM")

# crc32 bit by bit; the cheapest edits forward, a (cost, edits) pair for each of the four states; turns from the edits.
_EDIT = "struct_pack(c := {x}.c + {cost}, a := {x}.a || '{edit}')"
_NEVER = "struct_pack(c := 1000000000::BIGINT, a := '')"


def _edit(x: str, edit: str, cost: str) -> str:
    return _EDIT.format(x=x, edit=edit, cost=cost)


def _when(test: str, then: str) -> str:
    return f"CASE WHEN {test} THEN {then} ELSE {_NEVER} END"


_KEEP, _REROLE = "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)", "(CASE WHEN fault = 3 THEN 6 ELSE 1 END)"
_STAYS = "fault NOT IN (1, 2)"
_TO_USER = ", ".join(f"{_when(_STAYS + chr(32) + 'AND init = ' + chr(39) + 'u' + chr(39), _edit(x, 'K', _KEEP))}, {_when(_STAYS, _edit(x, 'R', _REROLE))}" for x in ("y0", "y1", "y3"))

OP12 = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS spot FROM conversations),
crc AS (
  SELECT spot, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(spot) + 1), lambda i: ascii(spot[i])::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::BIGINT)),
             lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 20 AS fate
  FROM (SELECT DISTINCT spot FROM base)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM base JOIN crc USING (spot) WHERE fate <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS init,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending FROM damaged),
r AS (
  SELECT conv_id, i, turn, role, text, init, lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN ending = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN ending NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM numbered),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '') AS x0, {_NEVER} AS x1, {_NEVER} AS x2, {_NEVER} AS x3 FROM stats
  UNION ALL
  SELECT conv_id, i, {_edit("y0", "D", "2")}, list_min([{_edit("y1", "D", "2")}, {_when(_STAYS + " AND init = 's'", _edit("y0", "K", _KEEP))}]),
         list_min([{_edit("y2", "D", "2")}, {_TO_USER}]),
         list_min([{_edit("y3", "D", "2")}, {_when(_STAYS + " AND init = 'a'", _edit("y2", "K", _KEEP))}, {_when(_STAYS, _edit("y2", "R", _REROLE))}])
  FROM (SELECT *, list_min([x3, {_edit("y2", "I", "5")}]) AS y3
        FROM (SELECT r.conv_id, r.i, init, fault, x0 AS y0, x1 AS y1, x3, list_min([x2, {_edit("x0", "I", "5")}, {_edit("x1", "I", "5")}, {_edit("x3", "I", "5")}]) AS y2
              FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))),
done AS (
  SELECT dp.conv_id, list_min([x0, x3, {_edit("x2", "I", "5")}, {_edit("x1", "II", "10")}]) AS best FROM dp JOIN stats ON stats.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = stats.n),
edits AS (SELECT conv_id, k, best.a[k] AS e FROM (SELECT conv_id, best, unnest(range(1, len(best.a) + 1)) AS k FROM done)),
placed AS (
  SELECT conv_id, k, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS o FROM edits),
turns AS (
  SELECT p.conv_id, p.k, e, o, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, max(CASE WHEN o = 1 AND e = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS shift
  FROM placed p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE e <> 'D'),
told AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS body FROM turns GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM every LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM every.conv_id
     LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM every.conv_id
"""

OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS at, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.at AS a, a.vec_id AS anchor_id, b.at AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.at <> b.at),
p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY a, p.b ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2, "op5_url_reputation": OP5, "op6_ngram_join": OP6, "op9_block_naming": OP9, "op10_decontaminate": OP10, "op11_chosen_path": OP11, "op12_conversation_repair": OP12, "op13_hard_negatives": OP13}
