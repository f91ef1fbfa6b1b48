"""The registered queries of the corpus operators, with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import fingerprints, jaccard, media, mixing, negatives, ngrams, packing, secrets, simhash, suffixes, toxicity, tries, warc
from riskloom.llm._shared import documents, remainder


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.train_and_score(documents(spark, sf_dir))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive_gaps", "archive_gap_bytes")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    """Fitted on labelled rows outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train(docs.filter(remainder("doc_id", 5) != 0), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    held_out, predicted = remainder("doc_id", 5) == 0, (F.col("score") >= 0.5).cast("int")
    offsets = F.transform("toxic_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), offsets.alias("toxic_offsets"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(documents(spark, sf_dir)).drop("text_hash")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = [r.name for r in secrets.BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    kinds = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *kinds, F.sha2(F.encode(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), "UTF-8"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(documents(spark, sf_dir), tokenizer_path())
    return packing.pack_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.write_media(documents(spark, sf_dir).select("doc_id", "text"))
    probed = media.read_payload(media.probe_media(stored, keep_media=True))
    ranges = F.transform("keyframe_ranges", lambda r: F.concat_ws("+", r["offset"].cast("string"), r["bytes"].cast("string")))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.trim("codec")),
        F.format_string("duration=%.2f", "duration"),
        F.concat(F.lit("samples="), F.col("samples").cast("string")),
        F.concat(F.lit("keyframes="), F.col("keyframes").cast("string")),
        F.concat(F.lit("ranges="), F.crc32(F.encode(F.array_join(ranges, ","), "UTF-8")).cast("string")),
    )
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")]
    return probed.select(*columns, "keyframe_ranges")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


_ALL = (
    op1_kneser_ney, op2_warc_salvage, op3_source_mix, op4_toxicity, op5_order_minhash, op6_jaccard_join, op7_secret_scan, op8_packing, op9_media_columns,
    op10_suffix_dedup, op11_prefix_trie, op12_hard_negatives, op13_simhash_links,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": tries.SQL, "op12_hard_negatives": negatives.SQL}
