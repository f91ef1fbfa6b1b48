"""A corpus pipeline of five stages; each reads all that the one before kept.

toxicity: documents that score 0.5 or more go. near_duplicates: of each group of documents linked by five-word shingles
(similarity 0.75) the one with the smallest doc_id stays. secrets: spans found become ``[kind]``. mixture: sources are drawn
to their target weights; a document drawn more than once is a row for each pass, with the words taken. packing: the
mixture's rows as pieces in sequences of at most 1,024 tokens.

Edge cases, the same in every stage: a null text counts as empty; null, empty and wordless documents pass every stage (the
mixture has nothing to draw from them and hands them on once) and end as a piece with the end id alone; repeated rows (equal id
and text) link with each other, and one of them stays; of ties in score or size none is decided by chance; rows with a null id
are documents like others, and go only where they repeat another; an empty table gives empty stages; columns of the input
besides those of ``documents`` are dropped by the first stage, whatever their names.

A stage removes the tables that the stage before it left in the checkpoint folder: by then that one's result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import jaccard, mixing, packing, secrets, toxicity
from riskloom.llm._shared import documents, owned, remove, sweep, written
from riskloom.llm.queries import tokenizer_path, toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_left: list[str] = []


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def _owning(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after the folders of the one before it are gone (those that ``docs`` doesn't read); its own are noted for the next."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        for folder in list(_left):
            if not any(f"/{folder.rsplit('/', 1)[-1]}/" in file for file in read):
                remove(spark, folder)
                _left.remove(folder)
        with owned() as mine:
            result = stage(spark, docs, sf_dir)
        _left.extend(mine)
        sweep(spark)
        return result

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the model learns from labelled rows outside the held-out fifth."""
    docs = docs.select(COLUMNS)
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).filter("score < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: that with the smallest doc_id."""
    return jaccard.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[kind]`` in place of each run of secret spans."""
    return _as_documents(secrets.find_secrets(docs.select(COLUMNS), redact=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows: the words drawn of a document in each pass over its source, and documents without words once."""
    return _as_documents(mixing.materialise(docs.select(COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places in sequences."""
    pieces = packing.cut_pieces(docs, tokenizer_path())
    return packing.pack_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", _owning(drop_toxic)),
    ("near_duplicates", _owning(drop_near_duplicates)),
    ("secrets", _owning(hide_secrets)),
    ("mixture", _owning(mix_sources)),
    ("packing", _owning(pack_sequences)),
]
#: The classifier, the seeded draws and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is computed once, in the checkpoint folder, and goes when the next is."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs, folder = written(stage(spark, docs, sf_dir), "stage")
        if before:
            remove(spark, before)
        before = folder
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return packed
