"""Near-duplicate vectors by spherical-cap filters.

The space is rotated at random and cut into two halves, each with a code of random unit vectors; a filter is a pair of
code words, one from either half, and a vector passes it if the sum of its two inner products exceeds a threshold.  A
vector lists its filters by walking one half's words in falling order of inner product until the other half's best can
no longer reach the threshold.  Vectors that share a filter are compared exactly.

The codes' size follows the number of vectors, so that a filter holds a few unrelated vectors, and the
threshold follows the number of filters that each vector should pass; a vector that passes fewer than that lowers it for
itself until it does.  Two vectors at the least similarity share about half of theirs.

A code has at most ``most_words`` words, as every vector is compared with each: from four and a half million vectors on
filters hold more unrelated vectors, in proportion, and more blocks of them are compared; the links stay the same.

Equal vectors are one class with a multiplicity.  A filter of more than ``block`` vectors is cut into blocks, compared
two by two in tasks of their own.  A pair is counted in the first filter that both share alone; a group returns counts
and a spanning forest of its links, never all of its pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of each
length have filters of their own and link among themselves alone; equal rows link with each other, and rows of one id
with different vectors are in one component; rows without an id link with nothing and have no component (null); an empty
table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .components import components
from .vectors import matrix, numbers, proper, usable


class Filters:
    """Structured random product codes for n vectors of a dimension."""

    def __init__(self, dim: int, n: int, each: int = 30, per_filter: int = 8, most_words: int = 4096, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim, self.half = dim, dim // 2
        self.words = int(min(most_words, max(16, math.ceil(math.sqrt(max(n, 1) * each / per_filter)))))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.codes = [self._unit(rng.standard_normal((self.words, k))) for k in (self.half, dim - self.half)]
        share = min(0.4, each / self.words**2)
        self.fewest = min(each, self.words**2)
        self.least = NormalDist().inv_cdf(1 - share) * math.sqrt(2 / dim)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def of(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row, sorted, the numbers of all filters that it passes."""
        turned = unit @ self.rotation
        left, right = turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T
        out = []
        for a, b in zip(left, right, strict=True):
            order = np.argsort(-b)
            falling, least = -b[order], self.least
            while True:
                firsts = np.flatnonzero(a >= least - b[order[0]])
                counts = np.searchsorted(falling, a[firsts] - least, side="right")
                if counts.sum() >= self.fewest:
                    break
                least -= 0.02  # a vector that stands apart from the codes looks wider around itself
            out.append(np.sort(np.repeat(firsts, counts) * self.words + np.concatenate([order[:c] for c in counts])))
        return out


def list_decoded(classes: DataFrame, filters: Filters) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = matrix(batch.column(2))
                biggest = np.abs(x).max(axis=1, keepdims=True)
                found = filters.of(Filters._unit(x / biggest))
                sizes = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(found).astype("int32")))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "copies", "x", "filters"])

    kind = classes.schema["x"].dataType.simpleString()
    return classes.mapInArrow(run, f"vec_id long, copies long, x {kind}, filters array<int>")


def _forest(a: list[int], b: list[int]) -> list[int]:
    """Positions of the links that join two trees."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


class _Rows:
    """Rows of whole filters, with unit vectors and filter lists as arrays."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids, self.copies, self.own, self.filter, self.i, self.j = (table.column(c).to_numpy() for c in ("vec_id", "copies", "own", "filter", "i", "j"))
        x = matrix(table.column("x").chunk(0))
        x = x / np.abs(x).max(axis=1, keepdims=True)
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        lists = table.column("filters").chunk(0)
        self.ends, self.values = lists.offsets.to_numpy(), lists.values.to_numpy()
        change = np.flatnonzero((self.filter[1:] != self.filter[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])) + 1
        self.starts = np.concatenate([[0], change, [len(self.ids)]])

    def before(self, row: int) -> np.ndarray:
        """A row's filters that come before the one at hand."""
        own = self.values[self.ends[row] : self.ends[row + 1]]
        return own[: np.searchsorted(own, self.filter[row])]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs of rows, in lots: short runs shifted against themselves, long ones block by block."""
        sizes = np.diff(self.starts)
        run = np.repeat(np.arange(len(sizes)), sizes)
        short = np.repeat((sizes <= SHORT) & (self.i[self.starts[:-1]] == self.j[self.starts[:-1]]), sizes)
        for shift in range(1, SHORT):
            p = np.flatnonzero((run[shift:] == run[:-shift]) & short[shift:])
            if not len(p):
                break
            for at in range(0, len(p), 100_000):
                part = p[at : at + 100_000]
                near = np.einsum("ij,ij->i", self.unit[part], self.unit[part + shift]) >= self.cosine - 1e-9
                yield part[near], part[near] + shift
        for k in np.flatnonzero(~short[self.starts[:-1]] & (sizes > 1)):
            s, e = self.starts[k], self.starts[k + 1]
            a, b = (s + np.flatnonzero(self.own[s:e] == side[s]) for side in (self.i, self.j))
            same = self.i[s] == self.j[s]
            for at in range(0, len(a), 256):
                rows = a[at : at + 256]
                p, q = np.nonzero(self.unit[rows] @ self.unit[b].T >= self.cosine - 1e-9)
                p, q = rows[p], b[q]
                yield (p[p < q], q[p < q]) if same else (p, q)

    def first_shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the filter at hand is the first one that the two rows of a pair share."""
        rows, at = np.unique(np.concatenate([p, q]), return_inverse=True)
        if len(p) < 64 or (self.filter[p] != self.filter[p[0]]).any():
            return np.array([not np.isin(x, y, assume_unique=True).any() for x, y in ((self.before(k), self.before(l)) for k, l in zip(p.tolist(), q.tolist(), strict=True))], bool)
        lists = [self.before(k) for k in rows.tolist()]
        values, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        held = np.zeros((len(rows), int((times > 1).sum()) + 1), "float32")
        place = np.where(times > 1, np.cumsum(times > 1), 0)[column]
        held[np.repeat(np.arange(len(rows)), [len(x) for x in lists]), place] = 1
        held = held[:, 1:]
        one, two = np.unique(at[: len(p)]), np.unique(at[len(p) :])
        shared = held[one] @ held[two].T > 0
        return ~shared[np.searchsorted(one, at[: len(p)]), np.searchsorted(two, at[len(p) :])]

    def links(self, cosine: float) -> list[tuple]:
        """(vec_id, null, count) and (vec_id, other, 0) for the links that belong to these filters."""
        self.cosine, counts = cosine, np.zeros(len(self.ids), "int64")
        kept_a: list[int] = []
        kept_b: list[int] = []
        for p, q in self.pairs():
            exact = np.einsum("ij,ij->i", self.unit[p], self.unit[q]) >= cosine
            p, q = p[exact], q[exact]
            if not len(p):
                continue
            first = self.first_shared(p, q)
            p, q = p[first], q[first]
            np.add.at(counts, p, self.copies[q])
            np.add.at(counts, q, self.copies[p])
            kept_a += self.ids[p].tolist()
            kept_b += self.ids[q].tolist()
            tree = _forest(kept_a, kept_b)
            kept_a, kept_b = [kept_a[k] for k in tree], [kept_b[k] for k in tree]
        some = np.flatnonzero(counts)
        return [*((i, None, n) for i, n in zip(self.ids[some].tolist(), counts[some].tolist(), strict=True)), *((a, b, 0) for a, b in zip(kept_a, kept_b, strict=True))]


SHORT = 32  # rows of a filter up to which its pairs are found by shifting
LOT = 50_000  # rows that a task looks at together


def linked(listed: DataFrame, cosine: float, block: int = 512) -> DataFrame:
    """(a, b, n): for b null a part of a's number of links, else a link of a spanning forest."""
    counts = listed.select(F.explode("filters").alias("filter")).groupBy("filter").count()
    large = stored(counts.filter(F.col("count") > block).select("filter", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    large = F.broadcast(large) if large.count() <= 1_000_000 else large  # 12 MB; beyond that a shuffled join
    dealt = listed.select("vec_id", "copies", "x", "filters", F.explode("filters").alias("filter"))
    dealt = dealt.join(large, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("vec_id", "copies", "x", "filters", "filter", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def done(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _Rows(pa.Table.from_batches(tables)).links(cosine)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n"])

        for batch in batches:  # a lot ends where a filter's block pair ends
            if sum(x.num_rows for x in kept) >= LOT:
                keys = [np.append(kept[-1].column(c).to_numpy()[-1], batch.column(c).to_numpy()) for c in ("filter", "i", "j")]
                cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
                if len(cut):
                    yield from done([*kept, batch.slice(0, int(cut[0]))])
                    kept, batch = [], batch.slice(int(cut[0]))
            if batch.num_rows:
                kept.append(batch)
        if kept:
            yield from done(kept)

    n = partitions(listed.sparkSession, 30 * listed.count(), 200_000)
    return dealt.repartition(n, "filter", "i", "j").sortWithinPartitions("filter", "i", "j").mapInArrow(run, "a long, b long, n long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    good = usable(df, key, vector)
    good = stored(good.withColumn("h", F.xxhash64("x")).withColumn("g", F.xxhash64("x", F.lit(1))), "vectors")
    classes = good.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("x", "vec_id").alias("x"))
    classes = stored(classes.withColumn("row", F.monotonically_increasing_id()), "classes")
    found = df.sparkSession.createDataFrame([], "a long, b long, n long")
    for dim, n in classes.groupBy(F.size("x")).count().filter("count > 1").collect():
        own = classes.filter(F.size("x") == dim).select(F.col("row").alias("vec_id"), "copies", "x")
        found = found.unionByName(stored(linked(stored(list_decoded(own, Filters(dim, n)), "filters"), cosine), "links"))
    # Classes are numbered, as one id may have several vectors; such an id links its classes.
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n"))
    named = classes.select("row", "rep")
    between = found.filter("b IS NOT NULL").join(named.select(F.col("row").alias("a"), F.col("rep").alias("x")), "a").join(named.select(F.col("row").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    held = good.select("vec_id", "h", "g").join(classes.select("h", "g", "rep"), ["h", "g"]).select("vec_id", "rep")
    several = held.groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most").select("vec_id", "b")
    same = held.join(several, "vec_id").select(F.col("rep").alias("a"), "b").filter("a <> b").distinct()
    groups = components(between.unionByName(same)).withColumnRenamed("node", "rep")
    summed = classes.join(counts, "row", "left").join(groups, "rep", "left").select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = good.select("vec_id", "h", "g").join(summed, ["h", "g"]).select("vec_id", "n_links", "component_id")
    id_ = F.col(key).cast("long")
    rest = df.filter(id_.isNull() | ~proper(numbers(df, vector))).select(id_.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), id_.alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
