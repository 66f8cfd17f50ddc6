"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _ring_sql(shards: int = 16, vnodes: int = 64) -> str:
    """The ring walk as SQL: round r offers each arc's unplaced keys to its r-th shard."""
    pos = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    parts = [f"""points AS (
  SELECT row_number() OVER (ORDER BY pos, shard) - 1 AS arc, pos, shard FROM (
    SELECT s.v AS shard, {pos.format("'shard-' || s.v || ':' || n.v")} AS pos
    FROM (SELECT unnest(range({shards})) AS v) s, (SELECT unnest(range({vnodes})) AS v) n)),
docs AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, coalesce(text, '') AS body,
         {pos.format("coalesce(doc_id::VARCHAR, '')")} AS pos FROM documents),
keyed AS (
  SELECT d.*, coalesce(p.arc, 0) AS arc FROM docs d ASOF LEFT JOIN points p ON d.pos <= p.pos),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos > (SELECT max(pos) FROM points), pos, doc_id, size) - 1 AS rank
  FROM keyed),
room AS (
  SELECT s.v AS shard, n // {shards} + (s.v < n % {shards})::INT AS cap
  FROM (SELECT unnest(range({shards})) AS v) s, (SELECT count(*) AS n FROM documents)),
walk AS (
  SELECT a.arc, b.shard, min((b.arc - a.arc + {shards * vnodes}) % {shards * vnodes}) AS dist
  FROM points a, points b GROUP BY 1, 2),
prefs AS (SELECT arc, shard, row_number() OVER (PARTITION BY arc ORDER BY dist) - 1 AS r FROM walk),
left_0 AS (SELECT arc, count(*) AS n, 0::BIGINT AS taken FROM ranks GROUP BY 1),
used_0 AS (SELECT shard, 0::BIGINT AS used FROM room)"""]
    for r in range(shards):
        parts.append(f"""got_{r} AS MATERIALIZED (
  SELECT l.arc, p.shard, l.n, l.taken, u.used + least(before, cap - u.used) AS base,
         greatest(0, least(l.n, cap - u.used - before)) AS got
  FROM (SELECT l.arc, l.n, l.taken, p.shard, coalesce(sum(l.n) OVER (
          PARTITION BY p.shard ORDER BY l.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM left_{r} l JOIN prefs p ON p.arc = l.arc AND p.r = {r}) l
  JOIN prefs p ON p.arc = l.arc AND p.r = {r} JOIN used_{r} u ON u.shard = p.shard JOIN room c ON c.shard = p.shard),
left_{r + 1} AS MATERIALIZED (SELECT arc, n - got AS n, taken + got AS taken FROM got_{r}),
used_{r + 1} AS MATERIALIZED (
  SELECT u.shard, u.used + coalesce(sum(g.got), 0) AS used FROM used_{r} u LEFT JOIN got_{r} g USING (shard) GROUP BY u.shard, u.used)""")
    segments = " UNION ALL ".join(f"SELECT arc, taken, got, shard, base FROM got_{r} WHERE got > 0" for r in range(shards))
    # CRC-32 is not a DuckDB function: a fold over the bytes with the table of the reflected polynomial.
    crc = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, t.crcs[xor(a & 255, b) + 1])))"""
    return ("WITH " + ",\n".join(parts) + f""",
segments AS ({segments}),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)),
  lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(0, 256)) AS i)))
SELECT d.doc_id, d.size, {crc} AS text_crc32, 'rows' AS law, s.shard::INTEGER AS shard,
       (s.base + d.rank - s.taken)::BIGINT AS slot, NULL::INTEGER AS grown_shard, p.shard::INTEGER AS home
FROM ranks d CROSS JOIN crc_table t JOIN points p ON p.arc = d.arc
JOIN segments s ON s.arc = d.arc AND d.rank >= s.taken AND d.rank < s.taken + s.got""")


ORACLE["op1_ring_shards"] = _ring_sql()

ORACLE["op2_winnow_contamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT *, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[j + 1:j + m], ' ') AS g
  FROM (SELECT item_id, m, w, unnest(range(0, len(w) - m + 1)) AS j FROM sized)),
sizes AS (SELECT DISTINCT m FROM sized),
grams AS (SELECT rid, p, m, array_to_string(w[p + 1:p + m], ' ') AS g
  FROM (SELECT d.rid, d.w, s.m, unnest(range(0, len(d.w) - s.m + 1)) AS p FROM d, sizes s WHERE len(d.w) >= s.m)),
seen AS (SELECT g.rid, g.p, g.m, x.item_id FROM grams g JOIN wins x ON x.m = g.m AND x.g = g.g),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM seen) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n_items,
  sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS h FROM seen GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  coalesce(f.h, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit h USING (rid) LEFT JOIN found f USING (rid)"""


#: CRC-32 is not a DuckDB function: its table, and a fold over the bytes of a text.
_CRC_TABLE = """SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)),
  lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(0, 256)) AS i))"""
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda a, b: xor(a >> 8, t.crcs[xor(a & 255, b) + 1])))"""


def _merkle_sql(levels: int = 21) -> str:
    """Trees of up to 3 ** 21 leaves, level by level; ``tree`` is the source, ``#`` before it in the tree of sources."""
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"

    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    hashed = "sha256({} || {})"
    up = []
    for name, first in (("n", "leaves"), ("m", "tops")):
        up.append(f"{name}0 AS MATERIALIZED (SELECT tree, pos, d, count(*) OVER (PARTITION BY tree) AS size FROM {first})")
        for k in range(levels):  # a tree of one node is through: it goes up unchanged
            up.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT tree, pos // 3 AS pos, CASE WHEN any_value(size) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d,
         (any_value(size) + 2) // 3 AS size FROM {name}{k} GROUP BY tree, pos // 3)""")
        if name == "n":
            up.append(f"""tops AS (SELECT '#' AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, d, s.tree AS own
  FROM (SELECT DISTINCT source, tree FROM docs) s JOIN n{levels} r ON r.tree = s.tree)""")
    steps = []
    for name, offset in (("n", 0), ("m", levels)):
        steps += [f"""SELECT tree, pos, {offset + k} AS k,
  coalesce(string_agg(d, '' ORDER BY pos) OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(d, '' ORDER BY pos) OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM {name}{k} WHERE size > 1""" for k in range(levels)]
    return f"""
WITH crc_table AS ({_CRC_TABLE}),
docs AS (
  SELECT doc_id, source, {field("source")} AS tree, {hashed.format(head, field("text"))} AS leaf, {_CRC.format(text="doc_id::VARCHAR")} AS crc,
         {hashed.format(head, field("replace(text, chr(10), '')"))} AS bare FROM documents, crc_table t),
leaves AS MATERIALIZED (SELECT *, leaf AS d, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
{", ".join(up)},
steps AS MATERIALIZED ({" UNION ALL ".join(steps)}),
levels AS (SELECT unnest(range({2 * levels})) AS k),
ways AS (
  SELECT l.tree, l.pos, list(s.a || '|' || s.b ORDER BY s.k) AS way, string_agg(s.a || s.b, '' ORDER BY s.k) AS proof
  FROM leaves l JOIN tops p ON p.own = l.tree CROSS JOIN levels v
  JOIN steps s ON s.k = v.k AND s.tree = CASE WHEN v.k < {levels} THEN l.tree ELSE '#' END
    AND s.pos = CASE WHEN v.k < {levels} THEN l.pos ELSE p.pos END // (3 ** (v.k % {levels}))::BIGINT
  GROUP BY l.tree, l.pos),
folded AS (
  SELECT l.doc_id, l.leaf, p.d AS subroot, r.d AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN l.crc % 2 = 0 THEN l.bare ELSE l.leaf END, coalesce(w.way, [])),
           lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM leaves l JOIN tops p ON p.own = l.tree CROSS JOIN m{levels} r LEFT JOIN ways w ON w.tree = l.tree AND w.pos = l.pos)
SELECT *, folded_root = root AS verified FROM folded"""


ORACLE["op11_merkle_manifest"] = _merkle_sql()

ORACLE["op13_importance_resampling"] = rf"""
WITH crc_table AS ({_CRC_TABLE}),
texts AS (SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, rid, unnest(w) AS f FROM split),
counted AS (SELECT side, rid, f, count(*) AS n FROM runs GROUP BY ALL),
vocabulary AS (SELECT f, {_CRC.format(text="f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table t),
hashed AS (SELECT side, rid, bucket, sum(n)::BIGINT AS n FROM counted JOIN vocabulary USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM hashed GROUP BY 1),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln(((x.t + 1)::DOUBLE * (y.s + 10000)::DOUBLE) / ((x.s + 1)::DOUBLE * (y.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums x, whole y),
weights AS (SELECT rid, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM hashed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (rid) WHERE side = 'd'),
ranks AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (
    PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) END AS r,
    count(*) FILTER (words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * able // 100 THEN r END AS rank FROM ranks"""
