"""SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

from . import mixing, warc

_SPACE = r"[\x20\x09-\x0D]+"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def mixing_sql() -> str:
    """The mixture by sorted running sums: what the hash thresholds find without a sort."""
    steps, taken = [], "FALSE"
    for i in range(mixing.PASSES):
        left = "TRUE" if i == 0 else f"NOT ({taken}) AND size <= room{i - 1} AND size > 0"
        base = "a0" if i == 0 else f"a{i}"
        budget = "budget" if i == 0 else f"room{i - 1}"
        steps.append(f"c{i} AS (SELECT *, {left} AS open{i}, sum(CASE WHEN {left} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) AS run{i} FROM {base})")
        steps.append(f"d{i} AS (SELECT *, open{i} AND run{i} <= {budget} AS take{i} FROM c{i})")
        # the limit also admits later passes' documents only by size, so the room is what the taken ones leave
        steps.append(f"a{i + 1} AS (SELECT *, {budget} - coalesce(sum(CASE WHEN take{i} THEN size END) OVER (PARTITION BY source), 0) AS room{i} FROM d{i})")
        taken = " OR ".join(f"take{j}" for j in range(i + 1))
    return f"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
z AS (SELECT source, sum(size)::HUGEINT AS z FROM t GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w FROM z),
p AS (SELECT *, sum(z) OVER () AS total, sum(w) OVER () AS weights, coalesce(sum(z) OVER f, 0) AS z0, coalesce(sum(w) OVER f, 0) AS w0 FROM w WINDOW f AS (ORDER BY z * 6 // w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, 3 * z * (weights - w0) <= w * (total - 3 * z0) AS capped FROM p),
u AS (SELECT *, coalesce(sum(CASE WHEN capped THEN z END) OVER (), 0) AS zc, coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS wc FROM q),
x AS (SELECT source, z::BIGINT AS source_size, CASE WHEN capped THEN (3 * z)::DOUBLE ELSE (w * (total - 3 * zc))::DOUBLE / (weights - wc)::DOUBLE END AS target FROM u),
y AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::INT AS times FROM x),
a0 AS (SELECT t.*, source_size, target, times, CASE WHEN times < 3 THEN floor(target - times * source_size) ELSE 0 END::HUGEINT AS budget FROM t JOIN y ON t.source IS NOT DISTINCT FROM y.source),
{", ".join(steps)}
SELECT doc_id, source, size, source_size, target, CASE WHEN size > 0 THEN times + ({taken})::INT ELSE 0 END::INT AS repeats, (size * CASE WHEN size > 0 THEN times + ({taken})::INT ELSE 0 END)::BIGINT AS taken FROM a{mixing.PASSES}"""


FILTER_AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
m AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, FALSE)::INT AS mask FROM w JOIN g USING (t)),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before FROM o, range(1, 6) r(step)),
p AS (SELECT part, filter_order, step, bit, n, good, toxic, mask & bit > 0 AS fails, mask & before::INT > 0 AS gone, mask = bit AS alone, 120 // greatest(bit_count(mask::INT), 1) AS share FROM h, s)
SELECT part, filter_order, step, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN fails THEN n * share ELSE 0 END)::BIGINT AS shapley
FROM p GROUP BY 1, 2, 3"""


def warc_sql() -> str:
    """Records by windows over equal payloads; base32 digit by digit from the hex of SHA-1; the position by a sort."""
    digit = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
    value = "({} * 65536 + {} * 4096 + {} * 256 + {} * 16 + {})".format(*(digit.format(f"5 * (i // 4) + {k}") for k in range(1, 6)))
    base32 = f"array_to_string(list_transform(range(0, 32), lambda i: substr('{warc.BASE32}', (({value} >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '')"
    return rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(?:www\d{{0,3}}\.)?', '') AS bare FROM pages),
k AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last,
  CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_extract(bare, '^([^/:?#]*)', 1), '.')), ',') || ')' || coalesce(nullif(regexp_extract(bare, '^[^/?#]*([^#]*)', 1), ''), '/') END AS url_key FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to,
  url_key, row_number() OVER (ORDER BY url_key COLLATE C, page_id & 4294967295, page_id) - 1 AS position FROM k"""


ORACLES: dict[str, str] = {"op2_exact_dedup": EXACT_DEDUP, "op4_near_dedup": NEAR_DEDUP, "op10_mixing": mixing_sql(), "op11_filter_audit": FILTER_AUDIT, "op12_warc": warc_sql()}
