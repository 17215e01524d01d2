"""Joins of short strings by likeness, through an index of segments instead of all pairs of like length.

The ratio of two strings (twice the letters of matching blocks over all letters) is at least ``least`` only if they are
at most ``(1 - least) * (|a| + |b|)`` inserted or deleted letters apart.  A name cut into one segment more than that has
a segment untouched, which then stands in the other string, moved by no more than those letters.  So strings meet on
(lengths, segment's number, segment), and only they are compared.  Names whose segment is very common are cut into one
segment more, of which two must be untouched, and meet on pairs of segments.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import sent_if_small

#: Names that may share a segment before pairs of segments are asked for; rows of an index that go to all tasks.
MOST_NAMES, MOST_SENT = 500, 500_000


def _sized(df: DataFrame, least: float, own: str, other: str) -> DataFrame:
    """Each string once for every length that a like one can have, and the letters that may be inserted and deleted.

    ``least`` is a ratio, or a number of edits (an int), each of which touches one segment and moves others by one.
    """
    n = F.col(own)
    if isinstance(least, int):
        df = df.withColumn(other, F.explode(F.sequence(F.greatest(F.lit(1), n - least), n + least)))
        return df.withColumn("apart", F.lit(least)).withColumn("inserted", F.lit(least)).withColumn("deleted", F.lit(least))
    df = df.withColumn(other, F.explode(F.sequence(F.ceil(n * least / (2 - least) - 1e-9).cast("int"), F.floor(n * (2 - least) / least + 1e-9).cast("int"))))
    apart = F.floor((1 - least) * (F.col("a") + F.col("b")) + 1e-9).cast("int")
    more = F.col("b") - F.col("a")
    # As many letters apart as the lengths differ, or an even number more.
    apart = apart - F.pmod(apart - more, F.lit(2))
    return df.withColumn("apart", apart).filter(F.col("apart") >= F.greatest(F.abs(more), F.lit(1))).withColumn("inserted", ((F.col("apart") + more) / 2).cast("int")).withColumn("deleted", ((F.col("apart") - more) / 2).cast("int"))


def _start(i: Column, parts: Column) -> Column:
    return F.floor(i * F.col("a") / parts).cast("int")


def _name_keys(names: DataFrame, least: float, extra: int) -> DataFrame:
    """name, kind, a, b, i (and j), key: the segments of a name of a letters for a partner of b letters."""
    sized, parts = _sized(names.withColumn("a", F.length("name")), least, "a", "b"), F.col("apart") + 1 + extra
    piece = lambda i: F.substring("name", _start(i, parts) + 1, _start(i + 1, parts) - _start(i, parts))
    keyed = sized.filter(F.col("a") >= parts).withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1)))
    if not extra:
        return keyed.select("name", "kind", "a", "b", "i", piece(F.col("i")).alias("key"))
    keyed = keyed.filter(F.col("i") < parts - 1).withColumn("j", F.explode(F.sequence(F.col("i") + 1, parts - 1)))
    return keyed.select("name", "kind", "a", "b", "i", "j", F.concat_ws("\0", piece(F.col("i")), piece(F.col("j"))).alias("key"))


def _text_keys(texts: DataFrame, least: float, lengths: DataFrame, extra: int) -> DataFrame:
    """text, kind, a, b, i (and j), key: what a like name's segments would be, wherever they may have moved to."""
    sized = _sized(texts.withColumn("b", F.length("text")), least, "b", "a").join(F.broadcast(lengths), ["kind", "a"])
    parts = F.col("apart") + 1 + extra

    def moved(df: DataFrame, i: str, at: str) -> DataFrame:
        start, size = _start(F.col(i), parts), _start(F.col(i) + 1, parts) - _start(F.col(i), parts)
        first, last = F.greatest(F.lit(0), start - F.col("deleted")), F.least(F.col("b") - size, start + F.col("inserted"))
        return df.filter(first <= last).withColumn(at, F.explode(F.transform(F.sequence(first, last), lambda p: F.substring("text", p + 1, size))))

    keyed = moved(sized.filter(F.col("a") >= parts).withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1))), "i", "key")
    if not extra:
        return keyed.select("text", "kind", "a", "b", "i", "key")
    keyed = keyed.filter(F.col("i") < parts - 1).withColumn("j", F.explode(F.sequence(F.col("i") + 1, parts - 1)))
    return moved(keyed, "j", "other").select("text", "kind", "a", "b", "i", "j", F.concat_ws("\0", "key", "other").alias("key"))


def _met(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(text, name): pairs of one kind that may be alike, each once."""
    texts, names = texts.select("text", "kind").filter("text <> ''").distinct(), names.select("name", "kind").filter("name <> ''").distinct()
    # Lengths of names, by kind: as many rows as there are different lengths.
    lengths = names.select("kind", F.length("name").alias("a")).distinct()
    index, on, which = _name_keys(names, least, 0), ["kind", "a", "b", "i", "key"], ["name", "kind", "b"]
    common = index.groupBy(*on).count().filter(F.col("count") > MOST_NAMES).drop("count")
    asked = _text_keys(texts, least, lengths, 0)
    meet = lambda keys, held, by: keys.join(sent_if_small(held, MOST_SENT), by).select("text", "name")
    if not common.head(1):
        return meet(asked, index, on).distinct()
    frequent = index.join(common, on, "left_semi").select(*which).distinct()
    pairs = _name_keys(names, least, 1).join(frequent, which, "left_semi")
    # A name that is too short for one segment more keeps its segments.
    kept = index.join(frequent.join(pairs.select(*which).distinct(), which, "left_anti"), which, "left_semi").unionByName(index.join(frequent, which, "left_anti"))
    of_pairs = _text_keys(texts, least, frequent.select("kind", F.length("name").alias("a")).distinct(), 1)
    return meet(asked, kept, on).unionByName(meet(of_pairs, pairs, [*on[:-1], "j", "key"])).distinct()


def similar(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(text, name, ratio) of all pairs of one kind that are not equal and whose ratio is at least ``least`` (over 2/3).

    texts: text, kind; names: name, kind.  Equal rows count once.  Null and empty strings are like nothing.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be over 2/3")
    apart = F.floor((1 - least) * (F.length("text") + F.length("name")) + 1e-9).cast("int")
    close = _met(texts, names, float(least)).filter((F.col("text") != F.col("name")) & (F.levenshtein("text", "name") <= apart))
    return close.mapInPandas(_ratios(least), "text string, name string, ratio double")


def within_edits(texts: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(text, name, distance) of all pairs of one kind that are not equal and at most so many edits (letters inserted,
    deleted or replaced) apart.  Names of at most ``most`` letters are met by their length alone."""
    met = _met(texts, names, most)
    tiny = names.filter((F.length("name") <= most) & (F.col("name") != "")).select("name", "kind").distinct()
    short = texts.filter((F.length("text") <= 2 * most) & (F.col("text") != "")).select("text", "kind").distinct()
    met = met.unionByName(short.join(tiny, "kind").select("text", "name")).distinct().filter(F.col("text") != F.col("name"))
    return met.withColumn("distance", F.levenshtein("text", "name")).filter(F.col("distance") <= most)


def _ratios(least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, name in zip(batch["text"], batch["name"], strict=True):
                match = difflib.SequenceMatcher(None, name, text)
                if match.quick_ratio() >= least and (ratio := match.ratio()) >= least:
                    out.append((text, name, ratio))
            yield pd.DataFrame(out, columns=["text", "name", "ratio"])

    return run
