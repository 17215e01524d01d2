"""Nearest vectors by largest inner product, with randomly rotated one-bit codes.

Every vector, less the mean, is padded, rotated at random and kept as the signs of its components: packed bits, its
length, and its inner product with its own code.  Codes are made once and written; blocks exchange codes alone.  A query
less nothing is rotated alike and rounded to four bits a component; its inner product with a code is a sum of bit counts
of (bits and plane).  From it, with two correction scalars, an inner product is estimated without bias, and an error
bound holds it with high probability.

Equal vectors are one class, of which the k + 1 smallest ids stand for all: no answer can hold a later one.

1. Block by block, the ``first`` vectors of largest estimate for each query; of all blocks' the best get their original
   vectors, by joins, for exact products.  The k-th largest of these is the query's floor.
2. Block by block again, the vectors whose upper bound reaches the floor are candidates, and get their original vectors
   for exact products.  Where a block has more than ``most`` of a query's, as with near copies, it names the query alone;
   the blocks so named then come with their vectors, and their k best of it are found in the task.  So no more rows than
   ``most`` a query and block leave a task.
3. The k best of all stay.

Bounds: the mean is fitted on at most ``sample`` vectors; every vector is indexed and compared.  Work is the number of
queries times the number of vectors, as a search of a stated query set against all rows is; a task holds the codes of
one block of each.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
lengths are no candidates for one another; ties go to the smaller id; of repeated rows of one query id the smallest
vector asks; repeated rows of a candidate are candidates each; fewer candidates than k give fewer rows; an empty table
gives an empty result; extra columns are not carried.  A candidate with the query's own id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, usable

SIGMAS = 2.0  # width of the error bound
PLANES = 4  # bits of a query's component
LOT = 512  # queries that meet a crowded block in one task
CODE = "vec_id long, j int, dim int, bits binary, length double, own double"
ASKED = "vec_id long, j int, dim int, planes binary, base double, step double, total double, with_centre double, length double"


class Codes:
    """The random rotation of one vector length and its codes."""

    def __init__(self, centre: np.ndarray, bits: int = 512, seed: int = 5):
        self.centre, dim = centre, len(centre)
        self.bits = 64 * -(-max(bits, dim) // 64)
        turned = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, dim)))[0]
        self.rotation = turned.T  # dim x bits, with orthonormal rows

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, length of the rest, product of the unit rest with its own code."""
        rest = x - self.centre
        length = np.linalg.norm(rest, axis=1)
        turned = (rest / np.maximum(length, 1e-300)[:, None]) @ self.rotation
        own = np.abs(turned).sum(axis=1) / np.sqrt(self.bits)
        return np.packbits(turned > 0, axis=1), length, np.maximum(own, 1e-6)

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bit planes of the rotated query's rounded components, their base and step, the sum of what they stand for,
        and the query's product with the mean."""
        turned = q @ self.rotation
        base = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - base) / (2**PLANES - 1), 1e-300)
        level = np.rint((turned - base[:, None]) / step[:, None]).astype("uint8")
        planes = np.concatenate([np.packbits((level >> p) & 1, axis=1) for p in range(PLANES)], axis=1)
        return planes, base, step, base * self.bits + step * level.sum(axis=1), q @ self.centre


def bounds(planes: np.ndarray, base: np.ndarray, step: np.ndarray, total: np.ndarray, q_length: np.ndarray, bits: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of query . rest, queries x vectors, and how far off they may be.  bits and planes as 64-bit words."""
    n = 64 * bits.shape[1]
    ones = np.bitwise_count(bits).sum(axis=1, dtype="int64")
    # A query's levels summed over a vector's bits, by a product of matrices: whole numbers, which single precision holds.
    kind = "float32" if n << PLANES < 2**24 else "float64"
    each = np.unpackbits(planes.view("uint8").reshape(len(planes), PLANES, n // 8), axis=2)
    level = sum((each[:, p].astype(kind) * 2**p for p in range(1, PLANES)), each[:, 0].astype(kind))
    sums = np.empty((len(planes), len(bits)))
    for at in range(0, len(bits), 4096):
        sums[:, at : at + 4096] = level @ np.unpackbits(bits[at : at + 4096].view("uint8"), axis=1).astype(kind).T
    half = base[:, None] * ones[None, :] + step[:, None] * sums  # over the components whose sign is plus
    estimate = (2 * half - total[:, None]) / np.sqrt(n) * (length / own)[None, :]
    spread = np.sqrt(np.maximum(1 - own**2, 0) / (own**2 * max(n - 1, 1))) * length
    rounding = step / 2 * np.sqrt(n / 3) / np.sqrt(n)  # of one rounded component, in the mean over signs
    return estimate, SIGMAS * (q_length[:, None] * spread[None, :] + rounding[:, None] * (length / own)[None, :])


def _coded(rows: DataFrame, codes: dict[int, Codes], queries: bool) -> DataFrame:
    """The codes of (vec_id, j, x), each vector by its length's rotation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                x, code = matrix(part.column(2)), codes[dim]
                ids, dims = part.column(0), pa.array(np.full(len(part), dim, "int32"))
                found = code.asked(x) if queries else code.of(x)
                packed = pa.array([row.tobytes() for row in found[0]], pa.binary())
                rest = [pa.array(c) for c in (*found[1:], np.linalg.norm(x, axis=1))[: 5 if queries else 2]]
                yield pa.RecordBatch.from_arrays([ids, part.column(1), dims, packed, *rest], names=[c.split()[0] for c in (ASKED if queries else CODE).split(", ")])

    return rows.mapInArrow(run, ASKED if queries else CODE)


def _pairs(asked: DataFrame, held: DataFrame, n_query_blocks: int, n_blocks: int, make, schema: str) -> DataFrame:
    """``make`` on the codes of each block of queries together with each block of vectors of one length."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int")).withColumn("j", every(n_blocks))
    v = held.withColumn("i", every(n_query_blocks))

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        queries, vectors = queries.combine_chunks(), vectors.combine_chunks()
        found: list[list] = [[], [], []]
        if len(queries) and len(vectors):
            words = lambda t, c: np.frombuffer(b"".join(t[c].to_pylist()), "uint64").reshape(len(t), -1)
            number = lambda t, c: t[c].to_numpy()
            planes, bits, ids, names = words(queries, "planes"), words(vectors, "bits"), number(vectors, "vec_id"), number(queries, "vec_id")
            side = [number(queries, c) for c in ("base", "step", "total", "length")]
            for at in range(0, len(names), 128):
                part = slice(at, at + 128)
                estimate, wide = bounds(planes[part], *(c[part] for c in side), bits, number(vectors, "length"), number(vectors, "own"))
                own = names[part, None] == ids[None, :]
                for held_, values in zip(found, make(names[part], ids, estimate, wide, own, number(queries, "floor")[part] if "floor" in queries.column_names else None, vectors["j"][0].as_py()), strict=True):
                    held_.extend(values.tolist())
        kinds = [f.split() for f in schema.split(", ")]
        return pa.table({name: pa.array(values, {"double": pa.float64(), "int": pa.int32()}.get(kind, pa.int64())) for (name, kind), values in zip(kinds, found, strict=False)})

    return q.groupBy("dim", "i", "j").cogroup(v.groupBy("dim", "i", "j")).applyInArrow(run, schema)


def _exact(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """(query_id, vec_id, score): the exact products of pairs of ids, in double precision."""
    double = lambda c: F.transform(c, lambda e: e.cast("double"))
    asking = queries.select(F.col("vec_id").alias("query_id"), "x")
    both = pairs.join(vectors.select("vec_id", F.col("x").alias("y")), "vec_id").join(F.broadcast(asking) if small else asking, "query_id").filter("size(x) = size(y)")
    score = F.aggregate(F.zip_with(double("x"), double("y"), lambda a, b: a * b), F.lit(0.0), lambda total, p: total + p)
    return both.select("query_id", "vec_id", score.alias("score"))


def _crowded(named: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for the queries that it has named, (query_id, j).

    Products are summed from the first component on, as ``_exact`` does.
    """
    asking = named.join(queries.select(F.col("vec_id").alias("query_id"), "x"), "query_id")
    # As many lots a block as its queries fill: its vectors go to each of them.
    per_block = F.broadcast(stored(named.groupBy("j").agg(F.least(F.lit(64), F.ceil(F.count("*") / LOT)).alias("n_lots")), "per_block"))
    spread = asking.join(per_block, "j").withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("n_lots")).cast("int")).drop("n_lots")
    lots = stored(spread.select("j", "lot").distinct(), "lots")
    lots = F.broadcast(lots) if lots.count() <= 1_000_000 else lots
    held = vectors.join(lots, "j").select("j", "lot", "vec_id", "x")

    def run(asked: pa.Table, here: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        asked, here = asked.combine_chunks(), here.combine_chunks()
        sizes = here["x"].combine_chunks().value_lengths().to_numpy() if len(here) else np.empty(0)
        for dim in np.unique(sizes).tolist() if len(asked) else ():
            part = here.filter(pa.array(sizes == dim))
            ids, y = part["vec_id"].to_numpy(), matrix(part["x"].combine_chunks())
            longest = float(np.linalg.norm(y, axis=1).max())
            alike = asked.filter(pc.equal(pc.list_value_length(asked["x"]), dim))
            names = alike["query_id"].to_numpy()
            queries_ = matrix(alike["x"].combine_chunks()) if len(alike) else np.empty((0, dim))
            for i, (name, q) in enumerate(zip(names.tolist(), queries_, strict=True)):
                if i % 64 == 0:
                    products = queries_[i : i + 64] @ y.T
                rough = np.where(ids == name, -np.inf, products[i % 64])
                # Sums in another order differ by far less than this.
                near = 1e-9 * float(np.linalg.norm(q)) * longest
                kept = np.flatnonzero(rough >= (np.partition(rough, -k)[-k] - near if len(rough) > k else -np.inf))
                kept = kept[ids[kept] != name]
                score = np.add.accumulate(y[kept] * q, axis=1)[:, -1]
                best = np.lexsort((ids[kept], -score))[:k]
                for held_, values in zip(found, ([name] * len(best), ids[kept[best]].tolist(), score[best].tolist()), strict=True):
                    held_.extend(values)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return spread.groupBy("j", "lot").cogroup(held.groupBy("j", "lot")).applyInArrow(run, "query_id long, vec_id long, score double")


def _classes(good: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows with the k + 1 smallest ids, at most k of each id.  Ranks are cut off before the shuffle."""
    alike = good.withColumn("a", F.xxhash64("x")).withColumn("b", F.xxhash64(F.lit(1), "x"))
    first = F.row_number().over(Window.partitionBy("a", "b", "vec_id").orderBy("vec_id"))
    smallest = F.dense_rank().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    return alike.withColumn("n", first).filter(F.col("n") <= k).drop("n").withColumn("n", smallest).filter(F.col("n") <= k + 1).drop("n", "a", "b")


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = 4096, first: int | None = None, most: int | None = None, block: int = 32_768, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product of every query row.

    first: how many vectors of largest estimate give a query's floor, 3 * k if not said.  most: how many candidates of a
    block a query takes before the block is asked for its k best, 10 * k if not said.
    """
    first, most = first or 3 * k, most or 10 * k
    good = stored(usable(df.select(F.col(key).alias("vec_id"), F.col(vector).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vec_id", "x", "asks"), "vectors")
    asking = stored(good.filter("asks").groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    some = good.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample).select("x").collect()
    codes = {}
    for dim in (r["n"] for r in good.select(F.size("x").alias("n")).distinct().collect()):
        own = [r["x"] for r in some if len(r["x"]) == dim]
        codes[dim] = Codes(np.array(own, float).mean(axis=0) if own else np.zeros(dim))
    kept = stored(_classes(good.select("vec_id", "x"), k), "classes")
    n_blocks = max(1, -(-kept.count() // block))
    # By the place of the row, which is written, so that blocks are of one size and stay what they are.
    kept = stored(kept.withColumn("j", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")), "blocks")
    held, asked = stored(_coded(kept.select("vec_id", "j", "x"), codes, False), "codes"), stored(_coded(asking.select("vec_id", F.lit(0).alias("j"), "x"), codes, True).drop("j"), "asked")
    n_queries = asked.count()
    n_query_blocks = max(1, -(-n_queries // query_block))
    small = n_queries * max(codes, default=0) <= 4_000_000  # 32 MB; beyond that a shuffled join

    # What query . centre adds is the same for all vectors of a length, so that estimates go without it.
    def likeliest(names, ids, estimate, wide, own, *_):
        estimate = np.where(own, -np.inf, estimate)
        need = min(first, estimate.shape[1])
        top = np.argpartition(estimate, estimate.shape[1] - need, axis=1)[:, estimate.shape[1] - need :]
        values = np.take_along_axis(estimate, top, 1)
        rows, columns = np.nonzero(np.isfinite(values))
        return names[rows], ids[top[rows, columns]], values[rows, columns]

    def reaching(names, ids, estimate, wide, own, floor, j):
        may = (estimate + wide >= floor[:, None]) & ~own
        many = may.sum(axis=1) > most
        rows, columns = np.nonzero(may & ~many[:, None])
        return np.concatenate([names[rows], names[many]]), np.concatenate([ids[columns], np.full(int(many.sum()), -1)]), np.concatenate([np.full(len(rows), -1), np.full(int(many.sum()), j)])

    likely = _pairs(asked, held, n_query_blocks, n_blocks, likeliest, "query_id long, vec_id long, estimate double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "vec_id"))
    likely = stored(likely.withColumn("place", place).filter(F.col("place") <= first).select("query_id", "vec_id").distinct(), "likely")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floors = _exact(likely, kept, asking, small).withColumn("place", best).filter(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    floor = F.coalesce(F.col("kth") - F.col("with_centre"), F.lit(float("-inf")))
    bounded = stored(asked.join(floors, "vec_id", "left").withColumn("floor", floor).drop("kth"), "bounded")
    reached = stored(_pairs(bounded, held, n_query_blocks, n_blocks, reaching, "query_id long, vec_id long, j int"), "reached")
    single = reached.filter("j < 0").select("query_id", "vec_id").unionByName(likely).distinct()
    scored = _exact(single, kept, asking, small)
    named = reached.filter("j >= 0").select("query_id", "j").distinct()
    if named.head(1):
        # What both ways find is one row; rows of a repeated candidate are counted below.
        scored = scored.unionByName(_exact(_crowded(named, asking, kept, k).select("query_id", "vec_id").distinct().join(single, ["query_id", "vec_id"], "left_anti"), kept, asking, small))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
