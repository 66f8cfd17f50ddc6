"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words the k-gram with the smallest hash is kept.  Two
texts that share ``window`` words keep the same k-gram of them, so a join of the kept
fingerprints of documents and benchmark items finds every shared window.  Each hit is then
extended to the windows around it, which are joined to the items' windows word for word: a
hash collision only costs a comparison.  An item of fewer words is one window of its own
length m, winnowed with k = m.

The plan is the same at every size.  Documents' fingerprints and texts pass fixed-size filters
of the benchmark's fingerprints and of the hit texts' keys, so what is shuffled is what is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestone.operators.key_filter import filter_words, only_possible, with_possible
from lakestone.session import scratch_path

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that is not lower-cased.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits of a fingerprint that hold its position; texts of more words are tried at each wrap.
POS_BITS = 26
_MASK = (1 << POS_BITS) - 1
_NONE = "array<bigint>"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of ``words`` of a text, without taking them out."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")


def _grams(w: Column, k: int, tag: int) -> Column:
    """At each position the hash of k words from there, its low bits replaced by the position."""
    def one(x: Column, i: Column) -> Column:
        h = F.xxhash64(F.lit(tag), x, *[F.get(w, i + j) for j in range(1, k)])
        return h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.bitwiseAND(F.lit(_MASK)).cast("long"))
    return F.transform(w, one)


def _winnowed(g: Column, n: Column, window: int, k: int) -> Column:
    """Smallest value of each ``window - k + 1`` consecutive grams, each kept once.  ``g`` is a plain column."""
    return F.array_distinct(F.slice(F.transform(
        g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, window - k + 1)])), F.lit(1), n - (window - 1)))


def _exploded(rows: DataFrame, ids: list[str], marks: Column) -> DataFrame:
    """(ids, hash, pos) from an array of marks; a position beyond the low bits is tried at every wrap."""
    # An inner explode would push a size test, with the whole expression in it, below the words.
    out = rows.withColumn("_marks", marks).select(*ids, "_n", F.explode_outer("_marks").alias("_v"))
    low = F.col("_v").bitwiseAND(F.lit(_MASK)).cast("int")
    out = out.select(*ids, "_n", F.col("_v").bitwiseAND(F.lit(~_MASK)).alias("hash"), low.alias("pos"))
    far = F.col("_n") > _MASK
    wraps = F.when(far, F.sequence(F.col("pos"), F.greatest("_n", "pos"), F.lit(_MASK + 1))).otherwise(F.array("pos"))
    return out.select(*ids, "hash", F.explode(wraps).alias("pos"))


def fingerprints(rows: DataFrame, ids: list[str], window: int, k: int, short: list[int]) -> DataFrame:
    """(ids, hash, pos) of texts given as ``_w`` (words) and ``_n`` (their number)."""
    n, w = F.col("_n"), F.col("_w")
    rows = rows.withColumn("_g", F.when(n >= window, _grams(w, k, 0)))
    marks = [F.when(n >= window, _winnowed(F.col("_g"), n, window, k)).otherwise(F.array().cast(_NONE))]
    marks += [F.when(n >= m, F.slice(_grams(w, m, m), F.lit(1), n - (m - 1))).otherwise(F.array().cast(_NONE))
              for m in short]
    return _exploded(rows, ids, F.concat(*marks))


def item_fingerprints(items: DataFrame, ids: list[str], window: int, k: int, short: list[int]) -> DataFrame:
    """Fingerprints of benchmark items: winnowed, or the one window of a short item."""
    n, w = F.col("_n"), F.col("_w")
    marks = F.when(n >= window, _winnowed(F.col("_g"), n, window, k))
    for m in short:
        marks = marks.when(n == m, F.slice(_grams(w, m, m), F.lit(1), F.lit(1)))
    rows = items.withColumn("_g", F.when(n >= window, _grams(w, k, 0)))
    return _exploded(rows, ids, F.coalesce(marks, F.array().cast(_NONE)))


def _windows(n: Column, size: Column) -> Column:
    """First positions of all windows of ``size`` words of a text of ``n`` >= ``size`` words."""
    return F.sequence(F.lit(0), n - size)


def _text_of(w: Column, at: Column, size: Column, sizes: list[int]) -> Column:
    """The words of a window, word by word (``slice`` would copy the whole text for each)."""
    made = F.lit(None).cast("string")
    for m in sizes:
        made = F.when(size == m, F.concat_ws(" ", *[F.get(w, at + j) for j in range(m)])).otherwise(made)
    return made


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def found_texts(texts: DataFrame, bench: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """(_k1, _k2, _hit, _items) of the texts, given as (_k1, _k2, _body), that hold a window of an item."""
    marked = fingerprints(texts.select("_k1", "_k2", words(F.col("_body")).alias("_w")).withColumn("_n", F.size("_w")),
                          ["_k1", "_k2"], window, k, short)
    bench = bench.withColumn("_m", F.least(F.lit(window), F.col("_n")))
    kept = _kept(item_fingerprints(bench.select("_m", "_w", "_n"), ["_m"], window, k, short).select("_m", "hash").distinct(),
                 "item-marks")
    # The low bits of a fingerprint are its position's, so the filter takes a hash of it.
    of_item = filter_words(kept.select(F.xxhash64("hash").alias("hash")))
    near = only_possible(marked, of_item, F.xxhash64("hash"))
    # Which marks of a text stand in some item, whichever: words that repeat cost one row a position.
    seeds = _kept(near.join(kept.hint("merge"), "hash").groupBy("_k1", "_k2")
                  .agg(F.collect_set(F.struct("pos", "_m")).alias("_seeds")), "seeds")
    seeded = only_possible(texts, filter_words(seeds.select(F.col("_k1").alias("hash"))), F.col("_k1"))
    one = seeded.groupBy("_k1", "_k2").agg(F.first("_body").alias("_body"))
    # Words stand below the join: in a projection of their own they would be split anew inside each lambda call.
    split = one.select("_k1", "_k2", words(F.col("_body")).alias("_w")).withColumn("_n", F.size("_w"))
    own = split.join(seeds.hint("merge"), ["_k1", "_k2"])
    # A window is its first position and size in one number, which array_distinct hashes.
    around = F.transform("_seeds", lambda s: F.transform(
        F.sequence(F.when(s["_m"] == window, F.greatest(s["pos"] - (window - k), F.lit(0))).otherwise(s["pos"]), s["pos"]),
        lambda p: p.cast("long") * (window + 1) + s["_m"]))
    at, size = (lambda x: F.floor(x / (window + 1)).cast("int")), (lambda x: (x % (window + 1)).cast("int"))
    sizes = [*short, window]
    # Windows are cut out before they are exploded: a row then holds one, not all words of its text.
    tried = (own.withColumn("_at", F.filter(F.array_distinct(F.flatten(around)), lambda x: at(x) + size(x) <= F.col("_n")))
             .select("_k1", "_k2", F.explode(F.transform("_at", lambda x: F.struct(
                 at(x).alias("p"), size(x).alias("m"), _text_of(F.col("_w"), at(x), size(x), sizes).alias("text")))).alias("_x"))
             .select("_k1", "_k2", F.col("_x.p").alias("_p"), F.col("_x.m").alias("_m"), F.col("_x.text").alias("_text")))
    of_items = (bench.select("_ids", F.explode(F.array_distinct(F.transform(
        _windows(F.col("_n"), F.col("_m")), lambda p: _text_of(F.col("_w"), p, F.col("_m"), sizes)))).alias("_text")).distinct())
    hit = _kept(tried.join(of_items.select("_text").distinct(), "_text"), "hit-windows")
    places = hit.groupBy("_k1", "_k2").agg(F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.collect_list(F.struct("_p", "_m")), lambda a: F.sequence(a["_p"], a["_p"] + a["_m"] - 1))))).alias("_hit"))
    ids = (hit.select("_k1", "_k2", "_text").distinct().join(of_items, "_text")
           .select("_k1", "_k2", F.explode_outer("_ids").alias("_id")).groupBy("_k1", "_k2")
           .agg(F.array_sort(F.collect_set("_id")).alias("_items")))
    return _kept(places.join(ids, ["_k1", "_k2"]), "hit-texts")


def _hits(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, k: int) -> DataFrame:
    """(_row, _w, _n_words, _hit, _items): a document as a struct, so that its columns may have any name."""
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and window")
    bench = (items.select(words(F.col(item_text)).alias("_w"), F.col(item_id).cast("string").alias("_id"))
             .filter(F.size("_w") > 0).groupBy("_w").agg(F.collect_set("_id").alias("_ids")).withColumn("_n", F.size("_w")))
    short = sorted(x["_n"] for x in bench.filter(F.col("_n") < window).select("_n").distinct().collect())  # < window values
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), body.alias("_body"),
                        F.xxhash64(body).alias("_k1"), F.xxhash64(F.lit(1), body).alias("_k2"))
    found = found_texts(keyed.select("_k1", "_k2", "_body"), bench, window, k, short)
    marked = with_possible(keyed, filter_words(found.select(F.col("_k1").alias("hash"))), F.col("_k1"), "_near")
    w = [words(F.col("_body")).alias("_w"), word_count(F.col("_body")).alias("_n_words")]
    no_hit, no_item = F.array().cast("array<int>"), F.array().cast("array<string>")
    clean = marked.where(~F.col("_near")).select("_row", *w, no_hit.alias("_hit"), no_item.alias("_items"))
    rest = (marked.where("_near").join(found.hint("merge"), ["_k1", "_k2"], "left")
            .select("_row", *w, F.coalesce("_hit", no_hit).alias("_hit"), F.coalesce("_items", no_item).alias("_items")))
    return clean.unionByName(rest)


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """``docs`` with ``_w`` (words), ``_n_words`` (their number), ``_hit`` (sorted positions of the words inside an
    occurrence of a window of some item) and ``_items`` (ids, as strings, of the items with
    occurring windows, sorted).

    Null and empty texts have no words and no hits; items without words are ignored;
    items with equal words are matched once and all reported (null ids are not); copies of
    a document share one lookup; repeated rows stay; extra columns are kept, whatever their
    names, but for these four, which are refused.
    """
    taken = {"_w", "_n_words", "_hit", "_items"} & set(docs.columns)
    if taken:
        raise ValueError(f"docs has columns that hits() adds: {sorted(taken)}")
    return _hits(docs, items, text, item_id, item_text, window, k).select("_row.*", "_w", "_n_words", "_hit", "_items")


def decontaminate(docs: DataFrame, items: DataFrame, max_hit_share: float = 0.0, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """Rows of ``docs`` whose share of hit words is at most ``max_hit_share``, columns unchanged, whatever their names.

    With the default any occurrence of a benchmark window removes a document.  Null and
    empty texts stay.
    """
    n_hit, n = F.size("_hit"), F.col("_n_words")
    kept = _hits(docs, items, text, item_id, item_text, window, k)
    return kept.filter((n == 0) | (n_hit / F.greatest(n, F.lit(1)) <= max_hit_share)).select("_row.*")
