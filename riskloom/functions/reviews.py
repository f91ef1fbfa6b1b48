"""Model reviews of source files: batching, reading replies, combining them. The model itself is a caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files that go first, by what their path ends in.
FIRST_FILES = ("build.rs", "lib.rs", "main.rs", "mod.rs")
HEADER_RESERVE = 200


_OPEN, _CLOSE, _END = "\n=== FILE: ", " ===\n", "\n"


def _section(path: Column, text: Column) -> Column:
    return F.concat(F.lit(_OPEN), path, F.lit(_CLOSE), text, F.lit(_END))


def _placed(files: Column, lead: Column, limit: int) -> Column:
    """Batches of a package's files (path, size, chars; in their order) as a fold over sizes: struct of the number of closed batches, the
    bytes in the open one, and for each file its first batch and its parts (0: whole)."""
    step = F.greatest(F.lit(1), limit - lead - HEADER_RESERVE)
    begin = F.struct(
        F.lit(0).cast("long").alias("closed"), lead.cast("long").alias("size"), F.array().cast("array<struct<path: string, first: bigint, parts: bigint>>").alias("files"),
    )

    def add(state: Column, file: Column) -> Column:
        wide = file["size"] > limit - lead
        full = state["size"] + file["size"] > limit
        closed = state["closed"] + F.when((wide | full) & (state["size"] > lead), 1).otherwise(0)
        parts = F.when(wide, F.ceil(file["chars"] / step)).otherwise(0)
        size = F.when(wide, lead).when(full, lead + file["size"]).otherwise(state["size"] + file["size"])
        placed = F.struct(file["path"].alias("path"), (closed + 1).alias("first"), parts.cast("long").alias("parts"))
        return F.struct((closed + parts).cast("long").alias("closed"), size.cast("long").alias("size"), F.array_append(state["files"], placed).alias("files"))

    return F.aggregate(files, begin, add)


def review_batches(files: DataFrame, packages: DataFrame, limit: int = 400_000) -> DataFrame:
    """(package_id, batch, batches, content) for files (package_id, path, content; paths differ inside a package).

    Batches have at most ``limit`` bytes, each led by the package's description. ``FIRST_FILES`` come first, then paths in order; a file
    that does not fit into a batch of its own is cut into parts, each a batch. Parts are cut by characters (as many as the limit leaves
    bytes), so those of texts that are not ASCII may be larger. Packages without files have one batch, the description.

    Packing is a fold over sizes, in the JVM: texts are not in it. They join their batch afterwards, so a task never holds a package's
    texts, only its list of files, and texts are shuffled once, to batches of bounded size.
    """
    head = F.concat_ws("\n", F.lit("=== PACKAGE ==="), F.concat(F.lit("Name: "), "name"), F.concat(F.lit("Repository: "), "repository"), F.concat(F.lit("Downloads: "), F.col("downloads").cast("string")), F.lit("===============\n\n"))
    leads = packages.select(F.col("id").alias("package_id"), head.alias("context")).withColumn("lead", F.octet_length("context").cast("long"))
    priority = F.lit(len(FIRST_FILES))
    for k, name in reversed(list(enumerate(FIRST_FILES))):
        priority = F.when(F.col("path").endswith(name), k).otherwise(priority)
    frame = len(_OPEN + _CLOSE + _END)
    size = (F.octet_length("path") + F.octet_length("content") + frame).cast("long")
    sized = files.select("package_id", F.struct(priority.alias("priority"), "path", size.alias("size"), F.char_length("content").cast("long").alias("chars")).alias("x"))
    lists = leads.join(sized.groupBy("package_id").agg(F.array_sort(F.collect_list("x")).alias("files")), "package_id")
    lists = lists.withColumn("state", _placed(F.col("files"), F.col("lead"), limit))
    batches = F.greatest(F.lit(1).cast("long"), F.col("state.closed") + F.when(F.col("state.size") > F.col("lead"), 1).otherwise(0))
    lists = lists.select("package_id", "lead", batches.alias("batches"), F.posexplode("state.files").alias("place", "x")).select("package_id", "lead", "batches", "place", "x.*")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), _section(F.col("path"), F.col("content")).alias("section")))
    step = F.greatest(F.lit(1), limit - F.col("lead") - HEADER_RESERVE).cast("int")

    def cut(k: Column) -> Column:
        title = F.concat(F.col("path"), F.lit(" (Part "), k.cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")"))
        return F.struct((k - 1).alias("part"), _section(title, F.substring(F.col("content"), ((k - 1) * step + 1).cast("int"), step)).alias("section"))

    sections = files.select("package_id", "path", "content").join(lists, ["package_id", "path"])
    each = F.when(F.col("parts") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("parts")), cut)).otherwise(whole)
    sections = sections.select("package_id", "batches", "first", "place", F.explode(each).alias("x"))
    joined = sections.groupBy("package_id", (F.col("first") + F.col("x.part")).alias("batch"), "batches").agg(F.expr("listagg(x.section, '') WITHIN GROUP (ORDER BY place)").alias("sections"))
    out = leads.join(joined, "package_id", "left")
    one = F.lit(1).cast("long")
    content = F.concat("context", F.coalesce("sections", F.lit("")))
    return out.select("package_id", F.coalesce("batch", one).cast("int").alias("batch"), F.coalesce("batches", one).cast("int").alias("batches"), content.alias("content"))


def ask(batches: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """``batches`` with ``reply`` or ``failure`` from a caller's client, a batch at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            replies, failures = [], []
            for content in pdf["content"]:
                try:
                    replies.append(client(content))
                    failures.append(None)
                except Exception as e:  # a failed batch is noted and does not end the package
                    replies.append(None)
                    failures.append(str(e))
            yield pdf.drop(columns="content").assign(reply=replies, failure=failures)

    return batches.mapInPandas(run, "package_id long, batch int, batches int, reply string, failure string")


def reply_score(reply: Column) -> Column:
    """The number on the first line that starts with SCORE:, from 0 to 100; 0 if there is none."""
    lines = F.filter(F.split(reply, r"\r?\n"), lambda x: F.trim(x).startswith("SCORE:"))
    number = F.trim(F.substring(F.trim(F.get(lines, F.lit(0))), 7, 1000)).try_cast("smallint")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(number.cast("int"), F.lit(0))))


def reply_notes(reply: Column) -> Column:
    """Up to ten lines after the SUMMARY: line; without any, the first 1,000 characters."""
    lines = F.split(reply, r"\r?\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x).startswith("SUMMARY:")), True).cast("int")
    notes = F.regexp_replace(F.array_join(F.slice(lines, F.greatest(at, F.lit(1)) + 1, 10), "\n"), r"^\s+|\s+$", "")
    return F.when((at > 0) & (notes != ""), notes).otherwise(F.substring(reply, 1, 1000))


def combine_reviews(replies: DataFrame) -> DataFrame:
    """(package_id, review_score, review_notes): the largest score, and the notes of suspicious or failed batches in order."""
    read = replies.withColumn("score", F.when(F.col("failure").isNull(), reply_score(F.col("reply"))).otherwise(0)).withColumn("notes", reply_notes(F.col("reply")))
    mark = F.concat(F.lit("[Batch "), F.col("batch").cast("string"), F.lit("/"), F.col("batches").cast("string"), F.lit("] "))
    text = F.when(F.col("failure").isNotNull(), F.concat(mark, F.lit("Analysis failed: "), "failure")).when((F.col("score") > 0) & (F.col("notes") != ""), F.when(F.col("batches") > 1, F.concat(mark, "notes")).otherwise(F.col("notes")))
    per = read.withColumn("text", text).groupBy("package_id").agg(F.max("score").alias("review_score"), F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY batch)").alias("notes"))
    return per.select("package_id", "review_score", F.coalesce("notes", F.lit("No suspicious findings")).alias("review_notes"))
