"""Benchmark decontamination by winnowing: fingerprints meet, and a hit is extended to the whole window.

Words are runs of digits, letters and all signs beyond ASCII, A-Z lower-cased.  Of every window of ``window`` consecutive
words the least hash among its runs of ``k`` words is the fingerprint, so a window that stands in two texts has the same
one in both: no shared span of ``window`` words is missed.  Documents keep the windows whose fingerprint an item may
have (a bit table of bounded size says so), these meet the items' windows on the fingerprint, and a hit counts where the
whole window agrees.  Windows that follow each other make longer spans.  Only DataFrame functions are used.

Defined cases: null, empty and wordless texts have no words; an item of fewer words than a window is one window of its
own length; every row of the documents is a document of its own, also where ids repeat or are missing; rows of one item
id are one item, and rows without an id are one item named by the empty string; equal windows count once for an item;
empty tables give empty or clean results; extra columns are not carried.  Windows are compared by 128 bits of hashes.

What grows: documents are scanned once, and only windows with an item's fingerprint leave the scan.  Item lists are made
once for each distinct set of windows, not for each document.  A document's list of items is in one task, as its digest
asks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import met, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word signs; capitals are lower-cased word by word, which is cheaper than text by text.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Longs in the bit table: at least 64 bits for each item window up to 16 MB, which is the most that is sent to tasks.
LEAST_SLOTS, MOST_SLOTS = 1 << 12, 1 << 21


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    """One 64-bit hash for each word of a text."""
    lowered = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), lambda w: F.xxhash64(lowered(w)))


def fingerprints(hashes: Column, length: int, k: int) -> Column:
    """For each window of so many words the least hash among its runs of k words (of the whole window, if shorter)."""
    k = min(k, length)
    runs = length - k + 1

    def least(grams: Column) -> Column:
        of = lambda i: F.least(*[F.get(grams, i + j) for j in range(runs)]) if runs > 1 else F.get(grams, i)
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - length), of)

    grams = F.transform(hashes, lambda _, i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(F.size(hashes) >= length, let(grams, least)).otherwise(F.array().cast("array<bigint>"))


def windows(hashes: Column, length: int, k: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<length, start, mark, rest>>: the windows of a text, by fingerprint and by a hash of the whole."""

    def listed(marks: Column) -> Column:
        starts = F.transform(marks, lambda _, i: i)
        starts = starts if wanted is None else F.filter(starts, lambda i: wanted(F.get(marks, i)))
        return F.transform(starts, lambda i: F.struct(F.lit(length).alias("length"), i.alias("start"), F.get(marks, i).alias("mark"), F.xxhash64(F.slice(hashes, i + 1, length)).alias("rest")))

    return let(fingerprints(hashes, length, k), listed)


def item_windows(items: DataFrame, key: str, text: str, window: int, k: int) -> tuple[DataFrame, list[int]]:
    """(item, length, mark, rest) once for each window of an item, and the lengths that there are (at most ``window``)."""
    known = stored(items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), word_hashes(F.col(text)).alias("h")).filter(F.size("h") > 0), "items")
    lengths = sorted(r[0] for r in known.select(F.least(F.size("h"), F.lit(window)).alias("n")).distinct().collect())
    parts = [known.filter(F.least(F.size("h"), F.lit(window)) == n).select("item", F.inline(windows(F.col("h"), n, k))) for n in lengths]
    none = known.select("item", F.inline(windows(F.col("h"), window, k))).limit(0)
    for part in parts:
        none = none.unionByName(part)
    return stored(none.select("item", "length", "mark", "rest").distinct(), "item-windows"), lengths


def _bit_table(marks: DataFrame, slots: int) -> Column:
    """The bits of all marks as one array of longs."""
    own = marks.groupBy(_slot(F.col("mark"), slots).alias("slot")).agg(F.bit_or(_bit(F.col("mark"))).alias("bits"))
    every = marks.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(own, "slot", "left").select("slot", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"])).scalar()


def _slot(mark: Column, slots: int) -> Column:
    return F.shiftrightunsigned(mark, 6).bitwiseAND(F.lit(slots - 1)).cast("int")


def _bit(mark: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), mark.bitwiseAND(F.lit(63)).cast("int"))


def covered(spans: Column) -> Column:
    """How many places a sorted array<struct<start, length>> covers."""
    first = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n"))

    def step(found: Column, span: Column) -> Column:
        until = F.greatest(found["until"], span["start"] + span["length"])
        return F.struct(until.alias("until"), (found["n"] + until - F.greatest(found["until"], span["start"])).alias("n"))

    return F.aggregate(spans, first, step, lambda found: found["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per document: key, n_words, n_hit, spans (start, length of the windows found), n_items, items, contaminated.

    ``items`` is the comma-joined list of item ids, sorted as strings.
    """
    held, lengths = item_windows(items, item, text, window, k)
    known = stored(held.select("length", "mark", "rest").distinct().withColumn("window", F.xxhash64("length", "mark", "rest")), "windows")
    n = known.count()
    slots = LEAST_SLOTS
    while slots < min(n, MOST_SLOTS):
        slots *= 2
    hashed = docs.select(F.col(key).alias("doc"), word_hashes(F.col(text)).alias("h"), _bit_table(known, slots).alias("bits"))

    def found(h: Column) -> Column:
        wanted = lambda mark: F.get(F.col("bits"), _slot(mark, slots)).bitwiseAND(_bit(mark)) != 0
        each = [windows(h, length, k, wanted) for length in lengths]
        near = F.concat(*each) if each else F.array().cast("array<struct<length:int,start:int,mark:bigint,rest:bigint>>")
        return F.struct(F.size(h).cast("long").alias("n_words"), near.alias("near"))

    rows = hashed.select(F.monotonically_increasing_id().alias("row"), "doc", let(F.col("h"), found).alias("found")).select("row", "doc", "found.n_words", "found.near")
    rows = stored(rows, "near")
    nothing = F.array().cast("array<struct<start:int,length:int>>")
    clean = rows.filter(F.size("near") == 0).select("doc", "n_words", nothing.alias("spans"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"))
    near = rows.filter(F.size("near") > 0).select("row", "doc", "n_words", F.inline("near"))
    hits = met(near, known, ["length", "mark", "rest"], "row", how="left")
    span = F.when(F.col("window").isNotNull(), F.struct("start", "length"))
    hits = hits.groupBy("row", "doc", "n_words").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set("window")).alias("windows"))
    hits = stored(hits.withColumn("same", F.struct(F.xxhash64("windows").alias("a"), F.xxhash64(F.lit(1), "windows").alias("b"))), "hits")
    # Documents with the same windows have the same items: each such list is made once.
    sets = hits.groupBy("same").agg(F.first("windows").alias("windows")).select("same", F.explode("windows").alias("window"))
    of = held.select(F.xxhash64("length", "mark", "rest").alias("window"), "item").distinct()
    listed = sets.join(of, "window").groupBy("same").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = stored(listed.select("same", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items")), "lists")
    dirty = met(hits, listed, ["same"], "row", how="left", bound=100_000).select("doc", "n_words", "spans", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"))
    out = clean.unionByName(dirty).withColumn("n_hit", covered(F.col("spans")))
    return out.select(F.col("doc").alias(key), "n_words", "n_hit", "spans", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"))
