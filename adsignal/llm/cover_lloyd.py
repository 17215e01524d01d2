"""Vector code compression: product codes by Lloyd's rounds over cover trees.

A vector's components become integers and are cut into equal parts; each part has a codebook of at most 256 entries.  The
vectors of a partition are laid down once as blocks, each with a cover tree for every part: a node covers a run of
points within a radius that halves from level to level, and running sums give the total of any run.  A round sends the
codebooks to all blocks.  A node whose centre is nearer to one entry than to any other by more than twice its radius
gives its whole run to that entry, sums included; entries farther than that are out of question for everything below it;
only ambiguous nodes are descended, and the points of ambiguous leaves are compared exactly.  Rounds exchange sums and
counts of entries alone, so they do not grow with the vectors.

Distances are whole numbers, held in doubles where these are exact, else in 64-bit integers.

Defined cases: vectors that are null or hold null or non-finite components are left out; every other row is kept, also
with repeated or missing ids (which come last); equal ids are taken by vector; shorter vectors and parts are filled up
with zeros at their end, an empty vector is all zeros; fewer rows than entries make a shorter codebook; components whose
integer is beyond sqrt(2^60 / length) (131,072 as a number at 64 components) count as that limit, so that an error fits
in 64 bits; a sum of errors that does not fit is null; no rows give no rows; extra columns are not carried.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import numbers

#: Vectors of a block (a tree's distances fill 32 MB while it is built), and points of a leaf.
BLOCK, LEAF = 2048, 8
#: Doubles hold whole numbers up to here.
EXACT = 2.0**53


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4.0 * largest * largest * points.shape[1] < EXACT:
        x, y = points.astype(float), entries.astype(float)
        return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    out = np.empty((len(points), len(entries)), dtype=np.int64)
    for n, entry in enumerate(entries):
        out[:, n] = ((points - entry) ** 2).sum(1)
    return out


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree of at least one point, level by level: order of the points; of each node its centre (a point), radius, run
    of the order, and run of children (empty at a leaf)."""
    between = np.sqrt(_squares(points, points).astype(float))
    # A level is a list of (members, centre); the members' order is settled as nodes are split.
    order = np.arange(len(points))
    nodes = [(0, len(points), 0)]
    centre, radius, first, last, kids_from, kids_to, level = [], [], [], [], [], [], [0]
    while nodes:
        below: list[tuple[int, int, int]] = []
        offset = len(centre) + len(nodes)
        for start, stop, middle in nodes:
            members = order[start:stop].copy()
            away = between[middle, members]
            reach = float(away.max())
            centre.append(middle)
            radius.append(reach)
            first.append(start)
            last.append(stop)
            kids_from.append(offset + len(below))
            if stop - start > LEAF and reach > 0:
                at, rest, near = start, members, away <= reach / 2
                while len(rest):
                    taken = rest[near]
                    order[at : at + len(taken)] = taken
                    below.append((at, at + len(taken), middle))
                    at, rest = at + len(taken), rest[~near]
                    if len(rest):
                        middle = int(rest[0])
                        near = between[middle, rest] <= reach / 2
            kids_to.append(offset + len(below))
        nodes = below
        level.append(len(centre))
    small = {k: np.array(v, dtype=np.int32) for k, v in {"order": order, "centre": centre, "first": first, "last": last, "kids_from": kids_from, "kids_to": kids_to, "level": level}.items()}
    return small | {"radius": np.array(radius)}


def assign(points: np.ndarray, tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sums, counts): each point's nearest entry (ties to the lower), and what each entry was given."""
    order = tree["order"]
    running = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points[order], axis=0, dtype=np.int64)])
    codes = np.empty(len(points), dtype=np.int32)
    sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)

    def give(starts: np.ndarray, stops: np.ndarray, to: np.ndarray) -> None:
        np.add.at(sums, to, running[stops] - running[starts])
        np.add.at(counts, to, stops - starts)
        for start, stop, code in zip(starts.tolist(), stops.tolist(), to.tolist(), strict=True):
            codes[order[start:stop]] = code

    nodes, may = np.array([0]), np.ones((1, len(entries)), dtype=bool)
    while len(nodes):
        squares = np.where(may, _squares(points[tree["centre"][nodes]], entries), np.inf)
        far = np.sqrt(squares)
        least = far.min(1)
        # A little more than twice the radius: roots are rounded, and an entry too many does no harm.
        keep = far <= (least + 2 * tree["radius"][nodes] + 1e-9 * (1 + least))[:, None]
        certain = (keep.sum(1) == 1) | (tree["radius"][nodes] == 0)
        sure = nodes[certain]
        give(tree["first"][sure], tree["last"][sure], squares[certain].argmin(1))
        nodes, keep = nodes[~certain], keep[~certain]
        kids = tree["kids_to"][nodes] - tree["kids_from"][nodes]
        leaf = kids == 0
        sizes = (tree["last"] - tree["first"])[nodes[leaf]]
        places = np.repeat(tree["first"][nodes[leaf]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        if len(places):
            own = np.where(np.repeat(keep[leaf], sizes, axis=0), _squares(points[order[places]], entries), np.inf)
            give(places, places + 1, own.argmin(1))
        kids = kids[~leaf]
        may = np.repeat(keep[~leaf], kids, axis=0)
        nodes = np.repeat(tree["kids_from"][nodes[~leaf]] - np.cumsum(kids) + kids, kids) + np.arange(kids.sum())
    return codes, sums, counts


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _points(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """Whole-number components, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    limit = math.isqrt((1 << 60) // max(length, 1))
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype("float64") * scale), -limit, limit).astype(np.int64)
    out = np.zeros((len(sizes), length), dtype=np.int64)
    out[np.arange(length)[None, :] < sizes[:, None]] = flat
    return out


def assigned(batch: pa.RecordBatch, codebooks: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Each block's points, and what ``assign`` gives for each of its parts."""
    for packed, trees in zip(batch.column("points").to_pylist(), batch.column("trees").to_pylist(), strict=True):
        points = np.load(io.BytesIO(packed))["points"].astype(np.int64)
        split = np.split(points, len(codebooks), axis=1)
        yield points, [assign(part, dict(np.load(io.BytesIO(tree))), book) for part, tree, book in zip(split, trees, codebooks, strict=True)]


class Quantiser:
    """Codebooks of a table's vectors; ``codebooks`` has the shape (parts, entries, components)."""

    def __init__(self, df: DataFrame, key: str, vector: str, *others: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> None:
        x = numbers(df, vector)
        finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
        self.parts, self.scale = parts, scale
        kept = df.select(F.col(key).alias("key"), x.alias("x"), F.struct(*others).alias("others") if others else F.struct(F.lit(0)).alias("others")).filter(F.col("x").isNotNull() & finite)
        longest = kept.agg(F.max(F.size("x"))).first()[0]
        self.length = -(-(longest or 0) // parts) * parts
        start = kept.select("key", "x").orderBy(F.asc_nulls_last("key"), "x").limit(entries).select("x").toArrow()
        own = _points(start.column("x").combine_chunks(), self.length, scale) if len(start) else np.zeros((0, self.length), dtype=np.int64)
        self.codebooks = own.reshape(len(own), parts, -1).transpose(1, 0, 2) if self.length else np.zeros((parts, len(own), 0), dtype=np.int64)
        self.blocks = stored(self._laid(kept), "blocks")
        for _ in range(rounds if len(own) else 0):
            self._round()

    def _laid(self, kept: DataFrame) -> DataFrame:
        """One row a block: keys, others, points (64-bit, or 32-bit where these are enough), and a packed tree for each part."""
        length, scale, parts = self.length, self.scale, self.parts
        schema = kept.schema
        kinds = f"keys array<{schema['key'].dataType.simpleString()}>, others array<{schema['others'].dataType.simpleString()}>, points binary, trees array<binary>"

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    rows = batch.slice(at, BLOCK)
                    points = _points(rows.column("x"), length, scale)
                    trees = [_packed(cover_tree(part)) for part in np.split(points, parts, axis=1)]
                    narrow = points.astype(np.int32) if np.abs(points).max(initial=0) < 1 << 31 else points
                    whole = pa.array([0, rows.num_rows], pa.int32())
                    columns = [pa.ListArray.from_arrays(whole, rows.column(c)) for c in ("key", "others")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([_packed({"points": narrow})], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], names=["keys", "others", "points", "trees"])

        return kept.mapInArrow(lay, kinds)

    def _round(self) -> None:
        spark = self.blocks.sparkSession
        sent = spark.sparkContext.broadcast(self.codebooks)

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                for _, found in assigned(batch, books):
                    for part, (_, total, n) in enumerate(found):
                        sums[part] += total
                        counts[part] += n
            flat = np.concatenate([counts.ravel(), sums.ravel()])
            given = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(given), pa.array(flat[given])], names=["slot", "total"])

        # Sums and counts by their place in the codebooks: as many rows as the codebooks have numbers, whatever the vectors.
        rows = self.blocks.select("points", "trees").mapInArrow(totals, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
        flat = np.zeros(self.codebooks.shape[0] * self.codebooks.shape[1] + self.codebooks.size, dtype=np.int64)
        flat[rows.column("slot").to_numpy()] = rows.column("total").to_numpy()
        counts, sums = np.split(flat, [self.codebooks.shape[0] * self.codebooks.shape[1]])
        counts = counts.reshape(self.codebooks.shape[:2])[:, :, None]
        self.codebooks = np.where(counts > 0, sums.reshape(self.codebooks.shape) // np.maximum(counts, 1), self.codebooks)
        sent.unpersist()

    def encode(self) -> DataFrame:
        """(key, others, code array<int>, error): every vector's entries and the sum of its squared distances to them."""
        sent = self.blocks.sparkSession.sparkContext.broadcast(self.codebooks)
        kinds = {c: self.blocks.schema[c].dataType.elementType.simpleString() for c in ("keys", "others")}

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = sent.value
            for batch in batches:
                for n, (points, found) in enumerate(assigned(batch, books)):
                    codes = np.stack([c for c, _, _ in found], axis=1)
                    nearest = np.concatenate([book[code] for book, (code, _, _) in zip(books, found, strict=True)], axis=1)
                    errors = ((points - nearest) ** 2).sum(1)
                    offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
                    columns = [batch.column("keys").slice(n, 1).flatten(), batch.column("others").slice(n, 1).flatten(), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(errors)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "others", "code", "error"])

        return self.blocks.mapInArrow(encoded, f"key {kinds['keys']}, others {kinds['others']}, code array<int>, error long")

    def text(self) -> str:
        """All numbers of the codebooks by part, entry and place, comma-joined."""
        return ",".join(map(str, self.codebooks.ravel().tolist()))
