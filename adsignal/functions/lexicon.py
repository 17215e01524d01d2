"""Large lexicons: which terms of a table each text contains, in one pass however many terms there are.

The terms are dealt into automata of bounded size.  Tasks run each over the texts as they come, so a text's time grows
with its length and its hits, not with the number of terms.  ``labels.hits`` is for short lists of literals.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of all terms of one automaton: about 200 MB in a task at most.  More terms make more automata, not larger ones.
MOST_LETTERS = 2_000_000
ROWS = 16_384


@functools.lru_cache(maxsize=1)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """An automaton is kept for the tasks of a worker that follow each other with the same terms."""
    built = ahocorasick.Automaton()
    for n, term in enumerate(terms):
        built.add_word(term, (n, len(term)))
    built.make_automaton()
    return built


def occurrences(text: str, automaton: ahocorasick.Automaton) -> dict[int, list[int]]:
    """By term: [count, first place, end of the last one counted]; occurrences that overlap the one before don't count."""
    found: dict[int, list[int]] = {}
    for end, (term, size) in automaton.iter(text):
        at = end - size + 1
        known = found.get(term)
        if known is None:
            found[term] = [1, at, end]
        elif at > known[2]:
            known[0] += 1
            known[2] = end
    return found


def _searched(rows: DataFrame, text: str, sent: Broadcast) -> DataFrame:
    kept = [c for c in rows.columns if c != text]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        if not terms:
            return
        automaton = _automaton(terms)

        def given(batch: pa.RecordBatch, places: list[int], hits: list[int], counts: list[int], firsts: list[int]) -> pa.RecordBatch:
            own = batch.take(pa.array(places, pa.int64()))
            columns = [own.column(c) for c in kept] + [pa.array([terms[h] for h in hits], pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[*kept, "term", "n", "first_at"])

        for batch in batches:
            places, hits, counts, firsts = [], [], [], []
            for place, value in enumerate(batch.column(text)):
                for hit, (n, first, _) in occurrences(value.as_py() or "", automaton).items():
                    places.append(place)
                    hits.append(hit)
                    counts.append(n)
                    firsts.append(first)
                if len(places) >= ROWS:
                    yield given(batch, places, hits, counts, firsts)
                    places, hits, counts, firsts = [], [], [], []
            yield given(batch, places, hits, counts, firsts)

    return rows.mapInArrow(run, f"{kinds}{', ' if kept else ''}term string, n bigint, first_at bigint")


def term_hits(rows: DataFrame, text: str, terms: DataFrame, term: str = "term", most_letters: int = MOST_LETTERS) -> DataFrame:
    """rows without their text, once for each term that the lower-cased text contains: term, n (times, those that overlap
    the one before left out), first_at (from 0).

    Terms are lower-cased, null and empty ones left out; each counts once.
    """
    spark = rows.sparkSession
    known = terms.select(F.lower(term).alias("term")).filter("term <> ''").distinct()
    letters = known.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    shards = max(1, -(-letters // most_letters))
    lowered = rows.withColumn(text, F.lower(text))
    out = None
    for number in range(shards):
        # One shard's terms come to the driver: their letters are bounded, whatever the lexicon.
        own = tuple(sorted(r["term"] for r in known.filter(F.pmod(F.xxhash64("term"), F.lit(shards)) == number).collect()))
        found = _searched(lowered, text, spark.sparkContext.broadcast(own))
        out = found if out is None else out.unionByName(found)
    return out


def lexicon_scores(rows: DataFrame, key: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """(key, name, hits, score): for each name of the lexicon (name, term, weight) the distinct terms that a text contains
    and the sum of their weights; names without a hit are left out.  Terms may serve several names.

    Rows are told apart by ``key``: rows of one key are one text's.
    """
    entries = lexicon.select("name", F.lower("term").alias("term"), F.col("weight").cast("double").alias("weight")).filter("term <> ''").groupBy("name", "term").agg(F.max("weight").alias("weight"))
    found = term_hits(rows.select(*key, text), text, entries).select(*key, "term").distinct()
    return found.join(entries, "term").groupBy(*key, "name").agg(F.count("*").alias("hits"), F.sum("weight").alias("score"))


def best_names(rows: DataFrame, key: list[str], text: str, lexicon: DataFrame, least: float = 0.0) -> DataFrame:
    """(key, name, hits, score): the name with the largest score of at least ``least``, ties to the first in the alphabet."""
    scored = lexicon_scores(rows, key, text, lexicon).filter(F.col("score") >= least)
    best = scored.groupBy(*key).agg(F.min_by(F.struct("name", "hits", "score"), F.struct(-F.col("score"), "name")).alias("best"))
    return best.select(*key, "best.*")
