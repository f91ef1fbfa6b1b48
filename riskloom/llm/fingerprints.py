"""Document fingerprints by order MinHash (operator 5), with DataFrame functions only.

The elements of a text are its sequences of k units, numbered by occurrence (the j-th equal one is another
element), so repeats count. A hash deals the elements to ``bins`` equal classes. In each class the
``width`` elements with the smallest hashes are selected, put back in text order, and hashed as a tuple:
one signature entry. Equal entries need the same elements in the same order, so likeness, the share of
equal entries among the classes that either text fills, falls with edit distance, not only with the
overlap of the sets. (One hash split into classes stands for as many independent hashes; each element is
hashed twice, whatever the number of entries.)

Units are words (between runs of space and U+0009 to U+000D; a text that begins or ends with such a run has an empty word there).
Of words of ``LONG_WORDS`` characters and more, as in scripts without spaces, each character is a unit.

All of it is higher-order functions over arrays of longs that hold (hash, position), sorted natively; a
text never leaves its row, so nothing is shuffled for a fingerprint.

Edge cases: a null or empty text has the single element of an empty word; texts under k units have one
element; positions are exact up to 2**24 units and wrap beyond (only order inside an entry could then
differ); equal texts have equal fingerprints, so repeated rows and copies do; ties of doc_id go by a hash
of the text; an empty table gives an empty one; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._shared import Scratch, cut, sweep

LONG_WORDS = 24
_POSITION = (1 << 24) - 1
_HASH = ~_POSITION


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _range(n: Column) -> Column:
    """0 .. n-1 (n is at least 1)."""
    return F.sequence(F.lit(0), n - 1)


def _units(text: Column) -> Column:
    words = F.split(text, "[\\x20\\x09-\\x0D]+")
    long = lambda x: F.char_length(x) >= LONG_WORDS
    apart = lambda w: F.flatten(F.transform(w, lambda x: F.when(long(x), F.split(x, "")).otherwise(F.array(x))))
    return _let(words, lambda w: F.when(F.exists(w, long), apart(w)).otherwise(w))


def fingerprint(text: Column, k: int = 3, bins: int = 64, width: int = 2, seed: int = 5) -> Column:
    """array<int>: an entry per class that the text fills; the top bits of an entry are its class."""
    bits = int(math.log2(bins))
    if 1 << bits != bins:
        raise ValueError("bins must be a power of two")
    hashed, place = F.lit(_HASH), F.lit(_POSITION)

    def packed(words: Column) -> Column:
        element = lambda i: F.xxhash64(F.lit(seed), *[F.get(words, i + j) for j in range(k)])
        return F.sort_array(F.transform(_range(F.greatest(F.lit(1), F.size(words) - (k - 1))), lambda i: element(i).bitwiseAND(hashed).bitwiseOR(i.cast("long").bitwiseAND(place))))

    def numbered(a: Column) -> Column:
        """Equal elements stand together, in text order: hash them again with their number in the run."""
        starts = F.filter(_range(F.size(a)), lambda i: (i == 0) | (F.get(a, i).bitwiseXOR(F.get(a, i - 1)).bitwiseAND(hashed) != 0))

        def runs(s: Column) -> Column:
            def run(start: Column, r: Column) -> Column:
                end = F.coalesce(F.get(s, r + 1), F.size(a)) - 1
                one = lambda q: F.xxhash64(F.get(a, q).bitwiseAND(hashed), q - start).bitwiseAND(hashed).bitwiseOR(F.get(a, q).bitwiseAND(place))
                return F.transform(F.sequence(start, end), one)

            return F.sort_array(F.flatten(F.transform(s, run)))

        return _let(starts, runs)

    def entries(s: Column) -> Column:
        kind = lambda i: F.shiftright(F.get(s, i), 64 - bits)
        firsts = F.filter(_range(F.size(s)), lambda i: (i == 0) | (kind(i) != kind(i - 1)))

        def entry(i: Column) -> Column:
            members = F.filter(F.slice(s, i + 1, width), lambda x: F.shiftright(x, 64 - bits) == kind(i))
            ordered = F.sort_array(F.transform(members, lambda x: F.shiftleft(x.bitwiseAND(place), 40).bitwiseOR(F.shiftrightunsigned(x, 24))))
            mixed = F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND(F.lit((1 << 40) - 1))))
            return F.shiftright(F.get(s, i).bitwiseAND(F.lit(-1 << (64 - bits))).bitwiseOR(F.shiftrightunsigned(mixed, bits)), 32).cast("int")

        return F.transform(firsts, entry)

    return _let(_let(_let(_units(F.coalesce(text, F.lit(""))), packed), numbered), entries)


def likeness(a: Column, b: Column, bins: int = 64) -> Column:
    """Share of equal entries among the classes that a or b fills."""
    bits = int(math.log2(bins))
    kinds = lambda x: F.transform(x, lambda e: F.shiftright(e, 32 - bits))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(kinds(a), kinds(b))))


def as_hex(fp: Column) -> Column:
    """A fingerprint as text, eight digits an entry."""
    return F.array_join(F.transform(fp, lambda e: F.lpad(F.lower(F.hex(e.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


_KEY = ["_id", "_hash"]
_NONE = -(1 << 63)  # stands for a null id, which comes last


def _keyed(docs: DataFrame) -> DataFrame:
    """(_id, _hash, text). The id can be had back from ``_id``, so that every use of the texts needs the same columns and Spark
    shuffles them once for all."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("_id"), F.xxhash64("doc_id", text).alias("_hash"), text.alias("text"))


def neighbours(rows: DataFrame, scratch: Scratch, bucket_rows: int = 50_000) -> DataFrame:
    """For rows (_id, _hash, n): the next row in descending _id (the first follows the last), as ``next``, and the row that
    it is next to, as ``prev`` (structs of _id, _hash, n). Ranges of ids are ordered by themselves; only their first and last
    rows meet in one place."""
    rows = scratch.keep(rows, "rows")
    buckets = max(1, math.ceil(rows.count() / bucket_rows))
    order = [F.col("_id").desc(), F.col("_hash")]
    dealt = scratch.keep(rows.repartitionByRange(buckets, *order).withColumn("_bucket", F.spark_partition_id()), "dealt")
    me = F.struct("_id", "_hash", "n")
    inside = Window.partitionBy("_bucket").orderBy(*order)
    dealt = dealt.withColumn("next", F.lead(me).over(inside)).withColumn("prev", F.lag(me).over(inside))
    first, last = (F.min_by(me, F.when(F.col(c).isNull(), 1)) for c in ("prev", "next"))
    ends = dealt.groupBy("_bucket").agg(first.alias("first"), last.alias("last"))
    across = Window.orderBy("_bucket")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("first").over(across), F.first("first").over(whole))
    before = F.coalesce(F.lag("last").over(across), F.last("last").over(whole))
    ends = ends.select("_bucket", after.alias("_after"), before.alias("_before"))
    near = dealt.join(ends, "_bucket").select(*_KEY, "n", F.coalesce("next", "_after").alias("next"), F.coalesce("prev", "_before").alias("prev"))
    return cut(near)


def edited_fingerprints(docs: DataFrame, **options) -> DataFrame:
    """Every text's fingerprint beside that of its edited text (the last half of its code points replaced by the first as many
    of the next document in descending doc_id) and the likenesses of both and of the next document's.

    Rows with equal doc_id and text are one document here, with one result each; other ties of doc_id go by a hash of the text.
    Texts are shuffled once, by their key; what each lends to its neighbour, once more.
    """
    bins = options.get("bins", 64)
    rows = _keyed(docs)
    with Scratch(docs.sparkSession) as scratch:
        near = neighbours(rows.groupBy(*_KEY).agg(F.max(F.length("text")).alias("n")), scratch)
        lender = rows.join(near.select(*_KEY, "prev").hint("merge"), _KEY)
        lent = lender.select(F.col("prev._id").alias("_id"), F.col("prev._hash").alias("_hash"), F.expr("left(text, prev.n div 2)").alias("lent"))
        lent = lent.groupBy(*_KEY).agg(F.first("lent").alias("lent"))
        edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), "lent")
        both = rows.hint("merge").join(lent, _KEY).select(*_KEY, F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
        made = both.select(
            *_KEY, "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            fingerprint(F.col("text"), **options).alias("f"), fingerprint(F.col("edited"), **options).alias("e"),
        )
        made = cut(made)
    sweep(docs.sparkSession)
    # The next document's fingerprint comes to each by two small joins on the key.
    follows = near.select(F.col("next._id").alias("_id"), F.col("next._hash").alias("_hash"), F.struct(*_KEY).alias("to"))
    own = made.groupBy(*_KEY).agg(F.first("f").alias("g"))
    after = own.join(follows, _KEY).select(F.col("to._id").alias("_id"), F.col("to._hash").alias("_hash"), "g")
    return made.join(after, _KEY).select(
        F.when(F.col("_id") != _NONE, F.col("_id")).alias("doc_id"), "n_chars", "edited_sha256",
        as_hex(F.col("f")).alias("fingerprint"), as_hex(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e"), bins).alias("near_edited"), likeness(F.col("f"), F.col("g"), bins).alias("near_next"),
    )
