"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards, at most one row apart (law ``rows``); ``home`` is the unbounded ring's shard."""
    from .sharding import assign
    placed = assign(_table(spark, sf_dir, "documents"), shards=16, vnodes=64, load_factor=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "home")


@query
def op2_winnow_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words inside benchmark windows and the items they come from."""
    from .decontaminate import hits
    found = hits(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size("_hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_hit") > 0).alias("contaminated"))


@query
def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    from .fingerprint import compare_edited
    return compare_edited(_table(spark, sf_dir, "documents"))


@query
def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and place under the optimal bucket boundaries."""
    from .packing import pack
    return pack(_table(spark, sf_dir, "documents"))


@query
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the digests and links of its response, metadata and conversion records."""
    from .warc import derivatives, responses
    made = derivatives(responses(_table(spark, sf_dir, "pages")))
    return made.select("page_id", "type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest",
                       "content_length", "title", "n_links", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("text", 256).alias("text_sha256"), F.sha2("record", 256).alias("record_sha256"))


@query
def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, from flat token files without an index."""
    from .tokencount import document_counts
    return document_counts(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", "ordinal", "start")


@query
def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a bigram automaton trained on those not held out."""
    from .lm import score
    return score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the number and offsets of its toxic spans."""
    from .toxicity import held_out, score, train
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
                         F.size("spans").cast("long").alias("n_spans"), "spans")


@query
def op3_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, its rows and its text's links."""
    from .neardup import classes
    return classes(_table(spark, sf_dir, "documents")).drop("node")


@query
def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its repeated passages; ``class_id`` is the smallest document that has one of them, or itself."""
    from .substring import repeated
    found = repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    inside = F.size(F.array_distinct(F.flatten(F.transform(
        "_passages", lambda p: F.sequence(p["start_word"], p["end_word"] - 1)))))
    return found.select(
        "doc_id", F.least("_owner", F.array_min(F.transform("_passages", lambda p: p["first_doc"]))).alias("class_id"),
        F.col("_n_words").alias("n_words"), inside.cast("long").alias("n_repeated_words"),
        F.size("_passages").cast("long").alias("n_passages"), F.col("_passages").alias("passages"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its text without line breaks folds to.

    Documents without an id stay as they are.
    """
    from .merkle import leaf, manifest, proof_digest
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    made = manifest(docs, leaf(*fields, F.col("text")), F.when(tampered, leaf(*fields, bare)))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of 150 % takes of every document, with its source's size and target."""
    from .mixing import mix, taken
    mixed = mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    targets = mixed.sources.select("source", F.col("size").alias("source_size"), "target")
    return (taken(mixed).join(targets, "source")
            .select("doc_id", "size", "source_size", "target", "taken"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document; the target is the benchmark's texts."""
    from .importance import resample
    return resample(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                    _table(spark, sf_dir, "benchmark").select("text"))
