"""Best-fit packing of documents into sequences of a fixed length, with swap-based local search.

A document is its token ids and the end id.  One longer than a sequence is cut into whole sequences, its first piece
taking what is over.  Pieces are dealt by a hash of their row's place into groups of about ``group_rows``, each
packed by itself: best fit decreasing, then exchanges between underfull bins (a move, one piece for one, two for one),
each of which increases the sum of squared fills, until bins empty and no exchange is left or the group has as few bins
as its tokens need.  Groups lose at most a fraction of a bin each, and none grows with the corpus.

Defined cases: a null text is the empty one, which is the end id alone; repeated rows are packed each, and so are rows
without an id, whose pieces have none either; ids of any size keep their value; an empty table gives an empty result;
extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import stored
from .shingles import release

ROWS = 256  # documents whose pieces are handed on together
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, crc32 of its ids."""
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, out = [], []
                for n, body in enumerate(part.column(1)):
                    ids = np.append(tokens.ids_of(body.as_py(), path), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % size or size
                    cuts = [0, *range(first, len(ids) + 1, size)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(n)
                        out.append((i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                found = np.array(out, "int64").T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(found[0].astype("int32")), *map(pa.array, found[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit decreasing: positions by bin.  Bins are kept by free room, rooms in a bit set."""
    by_room: dict[int, list[int]] = {}
    rooms, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


class _Offers:
    """What underfull bins can take, as arrays: per piece of theirs its bin, its length and the bin's free room.

    The piece -1 of length 0 stands for a plain move.  Rows of a bin that has changed are struck out by room 0.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], fill: list[int], size: int):
        self.lengths, self.bins, self.fill, self.size = lengths, bins, fill, size
        self.places: dict[int, list[int]] = {}
        self.n, self.table = 0, np.zeros((4, 1024), "int64")  # bin, piece, length, room

    def strike(self, b: int) -> None:
        for row in self.places.pop(b, ()):
            self.table[3, row] = 0

    def put(self, b: int) -> None:
        self.strike(b)
        room = self.size - self.fill[b]
        if 0 < room < self.size:
            rows = [(b, i, self.lengths[i], room) for i in self.bins[b]] + [(b, -1, 0, room)]
            while self.n + len(rows) > self.table.shape[1]:
                live = np.flatnonzero(self.table[3, : self.n])
                kept = self.table[:, live]
                self.table = np.zeros((4, max(1024, 2 * (len(live) + len(rows)))), "int64")
                self.table[:, : len(live)], self.n = kept, len(live)
                self.places = {}
                for row, owner in enumerate(kept[0].tolist()):
                    self.places.setdefault(owner, []).append(row)
            self.places[b] = list(range(self.n, self.n + len(rows)))
            self.table[:, self.n : self.n + len(rows)] = np.array(rows).T
            self.n += len(rows)


def exchange(lengths: list[int], bins: list[list[int]], size: int) -> list[list[int]]:
    """Local search: empty the least full bins into others by moves and by exchanges of one or two pieces for one."""
    least = max(-(-sum(lengths) // size), sum(2 * n > size for n in lengths))
    fill = [sum(lengths[i] for i in b) for b in bins]
    alive = sum(f > 0 for f in fill)
    todo = sorted((b for b in range(len(bins)) if 0 < fill[b] < size), key=lambda b: (fill[b], b))
    if alive <= least:
        return [b for b in bins if b]
    offers = _Offers(lengths, bins, fill, size)
    for b in todo:
        offers.put(b)
    for source in todo:  # what it gives makes fuller bins fuller still, so the sum of squares grows
        offers.strike(source)
        while fill[source] and alive > least:
            owner, piece, back, room = offers.table[:, : offers.n]
            live = (room > 0) & (room <= size - fill[source])
            own, best = bins[source], None
            seen = set()
            for offer in [(i,) for i in own] + [(own[x], own[y]) for x in range(len(own)) for y in range(x)]:
                total = sum(lengths[i] for i in offer)
                if (len(offer), total) in seen:
                    continue
                seen.add((len(offer), total))
                gain = total - back
                fits = np.flatnonzero(live & (gain > 0) & (gain <= room) & ((len(offer) == 1) | (piece >= 0)))
                if len(fits):
                    left = room[fits] - gain[fits]
                    at = fits[np.argmin(left)]
                    rank = (int(left.min()), -int(gain[at]))
                    if best is None or rank < best[0]:
                        best = rank, offer, int(owner[at]), int(piece[at]), int(gain[at])
            if best is None:
                break
            _, offer, target, returned, gain = best
            for i in offer:
                own.remove(i)
                bins[target].append(i)
            if returned >= 0:
                bins[target].remove(returned)
                own.append(returned)
            fill[source] -= gain
            fill[target] += gain
            offers.put(target)
            alive -= not fill[source]
        if alive <= least:
            break
        offers.put(source)
    return [b for b in bins if b]


def pack(found: DataFrame, size: int = 1024, group_rows: int = 16384) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; found must be stored, for it is counted first."""
    groups = max(1, -(-found.count() // group_rows))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("bucket").sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_pylist()
        bins = exchange(lengths, best_fit(lengths, size), size)
        sequence, offset = np.zeros(len(rows), "int64"), np.zeros(len(rows), "int64")
        for n, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = (key[0].as_py() << 32) | n, at
                at += lengths[i]
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # By the place of the row, not by its values: however many rows are equal, groups stay of one size.
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), groups))
    return dealt.groupBy("bucket").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    return pack(stored(pieces(docs, size, end_id, path), "pieces"), size)
