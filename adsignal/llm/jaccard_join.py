"""Jaccard join of documents on word shingles, with token-combination prefixes.

1. Every shingle of every document is counted: tasks send the shingles' leading bits, sorted and packed, to buckets
   that count them.  Shingles in at least ``frequent`` documents are frequent, those in at least ``hot`` are hot.
2. A document's shingles are ordered: those that no other document has (as far as a bitmap of fixed size tells), other
   rare ones, frequent ones by count; then by hash.  Two documents that are similar enough share one of the first p
   shingles, p following from size and threshold, and e + 1 of the first p + e.  Rare ones of the first p are index keys
   by themselves.
3. Equal sets are one class.  Each class is verified against one partner: the smallest document of a key, for the key
   owner that most of its keys name.  What this links is a component already.
4. What is left are pairs of different components.  For those, frequent shingles count two by two and hot ones three by
   three.  Shingles are dealt by hash into g groups, and only those of one group are combined, so that a document has
   about 5 p combinations and not p * p: of e + 1 shared shingles, e = g + min(2 g, hot shingles of the document), two
   frequent or three hot ones must be in one group.  g follows from the smaller document's size as a power of two, so
   both documents of a pair take the same; a document between two powers is indexed under either.  Keys are the rare
   shingles and the combinations that different components hold.  A document adds to each key how many shingles it can
   share at most if that key is the first one shared, at most all that some other document has too; so who has no
   possible partner at a key is dropped from it, and pairs of components for which this rules a link out aren't made.
   Of the other pairs at keys of few components the smaller one's documents visit the larger one: tasks hold blocks of
   both, count shared shingles by an index of the block, and return one link of a visitor at most.  The documents of
   keys that more components hold are dealt into blocks, and each two blocks meet in a task, which returns a forest of
   links: neither pairs of components nor of documents are made there, though the comparing is that of all blocks.

The frequent class is broadcast, at most ``most_frequent`` shingles: where there are more, its least count is doubled
until it fits, which costs work and no result.  A key of very many documents is salted; its parts meet in step 4.

Defined cases: null and empty texts, and those without words, have no shingles and link with nothing; shorter texts
than a shingle are one shingle; repeated rows are copies; rows without an id link with nothing and are in no component
(null); an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored
from .components import components
from .shingles import lots, mixed, release, sets

SALTED = 20_000  # documents of a key that one task looks at
STAR = 2_000  # documents that one task compares with one partner
GUESTS = 500  # documents that one task holds as visitors
FEW = 64  # components of a key whose pairs are made
BLOCK = 250_000  # shingles of a crowd's documents that meet those of another block in a task
GROUPED = 8  # a group for so many of the first p shingles
REPEATED_BITS = 27  # 16 MB; with more repeated shingles than bits it tells fewer of the unique ones, at a cost in work alone


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("t"))


def shingle_counts(docs: DataFrame, k: int, bits: int, least: int) -> DataFrame:
    """(token, n, bitmap) by shingles' first 32 + bits bits: those that at least ``least`` documents hold, and in a row
    without n, for each bucket, the piece of the bitmap with a bit set for shingles that more than one holds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held) >> np.uint64(32 - bits))
            bucket = (tokens >> np.uint64(32)).astype("int64")
            low = (tokens & np.uint64(0xFFFFFFFF)).astype("uint32")
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(cuts))
            press = zstandard.ZstdCompressor(level=1)
            blobs = []
            for b in full:
                steps = np.diff(low[cuts[b] : cuts[b + 1]], prepend=np.uint32(0))
                blobs.append(press.compress(np.ascontiguousarray(steps.view("uint8").reshape(-1, 4).T).tobytes()))  # byte planes
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "tokens"])

        for batch in batches:
            for _, _, data, ends in lots(_text(batch)):
                value, _ = sets(data, ends, k)
                if len(value):
                    held.append(value)
                    size += len(value)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held.clear()
        release()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("tokens"):
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), "uint8").reshape(4, -1)
            parts.append(np.cumsum(np.ascontiguousarray(planes.T).view("uint32").ravel(), dtype="uint32"))
        low = np.sort(np.concatenate(parts))
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.diff(np.append(starts, len(low)))
        many, bucket = n >= least, key[0].as_py()
        piece = np.zeros(1 << (REPEATED_BITS - bits), "uint8")
        piece[low[starts[n > 1]] >> np.uint32(32 + bits - REPEATED_BITS)] = 1
        return pa.table(
            {
                "token": np.append((np.int64(bucket) << 32) + low[starts[many]].astype("int64"), bucket),
                "n": pa.array([*n[many].tolist(), None], pa.int64()),
                "bitmap": pa.array([*[None] * int(many.sum()), np.packbits(piece).tobytes()], pa.binary()),
            }
        )

    return docs.mapInArrow(pack, "bucket long, tokens binary").groupBy("bucket").applyInArrow(count, "token long, n long, bitmap binary")


def repeated_bitmap(counts: DataFrame, bits: int) -> np.ndarray:
    """The whole bitmap, of 2 ** REPEATED_BITS bits at any size of corpus."""
    out = np.zeros(1 << (REPEATED_BITS - 3), "uint8")
    size = len(out) >> bits
    for row in counts.filter("n IS NULL").select("token", "bitmap").toLocalIterator():
        out[row["token"] * size : (row["token"] + 1) * size] = np.frombuffer(row["bitmap"], "uint8")
    return out


def frequent_class(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` tokens, sorted, and their counts: those of the largest counts, by powers of two."""
    by_power = {r["p"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}
    kept, floor = 0, 0
    for power in sorted(by_power, reverse=True):
        if kept + by_power[power] > most:
            floor = power + 1
            break
        kept += by_power[power]
    rows = counts.filter(F.floor(F.log2("n")) >= floor).select("token", "n").toArrow().sort_by("token")
    return rows["token"].to_numpy(), rows["n"].to_numpy()


SIGNED = "doc_id long, n long, h long, g long, n_hot long, cap long, keys array<struct<key:bigint,k:int,left:bigint>>"


def _needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The least number of shingles that a set of so many shares with any other that is similar enough."""
    return -(-percent * sizes // 100)


def _dealt(levels: np.ndarray, percent: int) -> np.ndarray:
    """Into how many groups frequent shingles are dealt, where the smaller set has 2 ** level shingles and more."""
    return np.maximum((100 - percent) * (1 << levels) // (100 * GROUPED), 1)


def signed(docs: DataFrame, k: int, percent: int, bits: int, hot: int, frequent) -> DataFrame:
    """Per document: size and two sums of its set, its number of hot shingles, how many shingles another document may have
    too (``cap``), and those that may be keys: rare ones of the first p (k 1), frequent (k 2) and hot ones (k 3) of the
    first p + e.  ``left``: how many come from it on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, repeated = frequent.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, data, ends in lots(_text(batch)):
                value, at = sets(data, ends, k)
                sizes = np.diff(at)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                short = (value >> np.uint64(32 - bits)).astype("int64")
                place = np.minimum(np.searchsorted(tokens, short), max(len(tokens) - 1, 0))
                count = np.where(tokens[place] == short, counts[place], 0) if len(tokens) else np.zeros(len(value), "int64")
                spot = (value >> np.uint64(64 - REPEATED_BITS)).astype("int64")
                once = ((repeated[spot >> 3] >> (7 - (spot & 7)).astype("uint8")) & 1) == 0
                count[once] = -1
                order = np.lexsort((value, count, owner))
                value_, count_ = value[order], count[order]
                rank = np.arange(len(value)) - np.repeat(at[:-1], sizes)
                n_hot = np.bincount(owner[count_ >= hot], minlength=len(sizes))
                cap = sizes - np.bincount(owner[count_ < 0], minlength=len(sizes))
                p = sizes - _needed(sizes, percent) + 1
                groups = _dealt(np.log2(np.maximum(sizes, 1)).astype("int64"), percent)
                far = p + groups + np.minimum(2 * groups, n_hot)
                held = np.flatnonzero(((rank < p[owner]) & (count_ == 0)) | ((rank < far[owner]) & (count_ > 0)))
                kind = 1 + (count_[held] > 0) + (count_[held] >= hot)
                keys = pa.StructArray.from_arrays([pa.array(value_[held].view("int64")), pa.array(kind.astype("int32")), pa.array((sizes[owner] - rank)[held])], names=["key", "k", "left"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[held], minlength=len(sizes)))]), pa.int32()), keys)
                sums = [np.add.reduceat(np.append(x, np.uint64(0)), at[:-1]) * (sizes > 0).astype("uint64") if len(sizes) else np.empty(0, "uint64") for x in (value, mixed(value + np.uint64(7)))]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(sizes, pa.int64()), *(pa.array(s.view("int64")) for s in sums), pa.array(n_hot.astype("int64")), pa.array(cap.astype("int64")), lists], names=["doc_id", "n", "h", "g", "n_hot", "cap", "keys"])

    return docs.mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, last, data, ends in lots(_text(batch)):
                value, at = sets(data, ends, k)
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array([value[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """Broadcast up to a million rows of a few numbers; beyond that a shuffled join."""
    return F.broadcast(rows) if n <= 1_000_000 else rows


def stars(docs: DataFrame, first: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of ``first`` (a, b), one for each a, that are similar enough: (a, b).

    A partner's set is sent once for every ``STAR`` documents that are compared with it, theirs once each.
    """
    sizes = first.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    members = first.join(sizes, "b").select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_hub"))
    hubs = sizes.select(F.col("b").alias("doc_id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_hub"))
    rows = stored(members.unionByName(hubs), "stars")
    n = rows.count()
    held = full_sets(docs.join(_sent(rows.select("doc_id").distinct(), n), "doc_id", "left_semi"), k)
    dealt = held.join(_sent(rows, n), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, None
        for batch in batches:
            ids, named, salts, is_hub, held_sets = (batch.column(c) for c in ("doc_id", "hub", "salt", "is_hub", "shingles"))
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                here, own = (named[i].as_py(), salts[i].as_py()), np.frombuffer(held_sets[i].as_buffer(), "uint64")
                if is_hub[i].as_py():
                    at, x = here, own
                elif at == here and similar(x, own, percent):
                    found.append((ids[i].as_py(), here[0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        release()

    parts = partitions(docs.sparkSession, n, 20_000)
    return dealt.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub")).mapInArrow(run, "a long, b long")


def may_link(keys: DataFrame, percent: int) -> DataFrame:
    """keys (doc_id, n, component, key, left) by (key, component), without those that no other of their key can link with:
    key, component, n, left, components (how many the key has), same (a sum by which equal sets of components are told).

    ``left``: how many shingles the document can share at most, if the key is the first thing that it shares.  So its
    partner has at most (100 + percent) / percent * left - n shingles, and has to allow for as many as it has itself.
    """
    held = keys.groupBy("key", "component").agg(F.min("n").alias("n"), F.max("left").alias("left")).withColumn("most", F.expr(f"({100 + percent} * left - {percent} * n) DIV {percent}"))
    bounds = held.groupBy("key").agg(F.min("n").alias("least_n"), F.max("most").alias("largest"))
    kept = held.join(bounds, "key").filter("least_n <= most AND n <= largest").drop("least_n", "largest", "most")
    sums = kept.groupBy("key").agg(F.count("*").alias("components"), F.sum(F.xxhash64("component").cast("decimal(38,0)")).alias("same"))
    return kept.join(sums.filter("components > 1"), "key")


def cross_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of components (a, b) that share a key of few components by which documents of theirs may be linked.

    held: ``may_link``.  A pair that is similar enough passes at its first key.
    """
    few = held.filter(F.col("components") <= FEW)
    one, two = (few.select("key", F.col("component").alias(x), F.col("n").alias(f"n_{x}"), F.col("left").alias(f"l_{x}")) for x in "ab")
    enough = F.expr(f"least(l_a, l_b) * {100 + percent} >= {percent} * (n_a + n_b)")
    return one.join(two, (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & enough).select("a", "b").distinct()


def crowds(docs: DataFrame, held: DataFrame, keys: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between documents of keys that more components hold: a forest of them for any two blocks.

    Keys of the same components are one crowd.  Its documents are dealt into blocks, and each two blocks meet in a task,
    where components that were found to be linked are one from then on: no pairs of components are made.
    """
    many = held.filter(F.col("components") > FEW)
    crowd_of = many.select("key", "components", "same").distinct().join(many.groupBy("components", "same").agg(F.min("key").alias("crowd")), ["components", "same"]).select("key", "crowd")
    rows = keys.select("key", "doc_id", "component", "n").join(many.select("key", "component"), ["key", "component"], "left_semi").join(crowd_of, "key").select("crowd", "doc_id", "component", "n").distinct()
    rows = stored(rows, "crowds")
    sizes = rows.groupBy("crowd").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    met = rows.join(sizes, "crowd").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = stored(met.select("crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "component", (F.col("own") <= F.col("other")).alias("is_guest"), (F.col("own") >= F.col("other")).alias("is_host")), "meetings")
    n = met.count()
    sets_ = full_sets(docs.join(_sent(met.select("doc_id").distinct(), n), "doc_id", "left_semi"), k)
    dealt = sets_.join(_sent(met, n), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        guests: list[tuple[int, int, np.ndarray]] = []
        hosts: list[tuple[int, int, np.ndarray]] = []

        def meet() -> Iterator[pa.RecordBatch]:
            root: dict[int, int] = {}

            def of(c: int) -> int:
                while root.setdefault(c, c) != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            found = []
            if guests and hosts:
                lengths = np.array([len(x) for _, _, x in hosts])
                tokens = np.concatenate([x for _, _, x in hosts])
                order = np.argsort(tokens)
                tokens, owner = tokens[order], np.repeat(np.arange(len(hosts)), lengths)[order]
                for name, component, x in guests:
                    low, high = np.searchsorted(tokens, x, side="left"), np.searchsorted(tokens, x, side="right")
                    times = high - low
                    spots = np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
                    shared = np.bincount(owner[spots], minlength=len(hosts))
                    for h in np.flatnonzero(100 * shared >= percent * (len(x) + lengths - shared)).tolist():
                        if of(component) != of(hosts[h][1]):
                            root[of(component)] = of(hosts[h][1])
                            found.append((name, hosts[h][0]))
                del tokens, owner, order
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
            guests.clear()
            hosts.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("crowd", "i", "j", "doc_id", "component", "is_guest", "is_host")]
            for crowd, i, j, name, component, is_guest, is_host, own_set in zip(*columns, batch.column("shingles"), strict=True):
                if at != (crowd, i, j):
                    yield from meet()
                    at = (crowd, i, j)
                x = np.frombuffer(own_set.as_buffer(), "uint64").copy()
                if is_guest:
                    guests.append((name, component, x))
                if is_host:
                    hosts.append((name, component, x))
        yield from meet()
        release()

    parts = partitions(docs.sparkSession, n, 20_000)
    return dealt.repartition(parts, "crowd", "i", "j").sortWithinPartitions("crowd", "i", "j").mapInArrow(run, "a long, b long")


def visits(docs: DataFrame, pairs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between documents of the paired components, one of each visitor and block at most.

    pairs: components a, b.  members: doc_id, component.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    both = pairs.join(sizes.select(F.col("component").alias("a"), F.col("m").alias("m_a")), "a").join(sizes.select(F.col("component").alias("b"), F.col("m").alias("m_b")), "b")
    larger = F.col("m_a") >= F.col("m_b")
    turned = stored(both.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("guest")), "turned")
    guests = stored(turned.join(members.withColumnRenamed("component", "guest"), "guest").select("home", "doc_id"), "guests")
    homes = guests.groupBy("home").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("guest_blocks")).join(sizes.select(F.col("component").alias("home"), F.ceil(F.col("m") / STAR).cast("int").alias("home_blocks")), "home")
    homes = stored(homes, "homes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    came = guests.join(homes, "home").select("home", every("home_blocks").alias("i"), own("guest_blocks").alias("j"), "doc_id", F.lit(True).alias("is_guest"))
    stay = members.join(homes, members["component"] == homes["home"]).select("home", own("home_blocks").alias("i"), every("guest_blocks").alias("j"), "doc_id", F.lit(False).alias("is_guest"))
    rows = stored(came.unionByName(stay), "visits")
    n = rows.count()
    held = full_sets(docs.join(_sent(rows.select("doc_id").distinct(), n), "doc_id", "left_semi"), k)
    dealt = held.join(_sent(rows, n), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        visitors: list[tuple[int, np.ndarray]] = []
        here: list[tuple[int, np.ndarray]] = []
        size = 0

        def meet() -> Iterator[pa.RecordBatch]:
            """Compare all visitors with the documents gathered; who is linked visits no more here."""
            if here and visitors:
                tokens = np.concatenate([x for _, x in here])
                lengths = np.array([len(x) for _, x in here])
                order = np.argsort(tokens)
                tokens, owner = tokens[order], np.repeat(np.arange(len(here)), lengths)[order]
                found, rest = [], []
                for name, x in visitors:
                    low, high = np.searchsorted(tokens, x, side="left"), np.searchsorted(tokens, x, side="right")
                    times = high - low
                    spots = np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
                    shared = np.bincount(owner[spots], minlength=len(here))
                    linked = np.flatnonzero(100 * shared >= percent * (len(x) + lengths - shared))
                    if len(linked):
                        found.append((name, here[int(linked[0])][0]))
                    else:
                        rest.append((name, x))
                visitors[:] = rest
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
            here.clear()

        for batch in batches:
            for home, i, j, name, is_guest, own_set in zip(*(batch.column(c).to_pylist() for c in ("home", "i", "j", "doc_id", "is_guest")), batch.column("shingles"), strict=True):
                if at != (home, i, j):
                    yield from meet()
                    at, size = (home, i, j), 0
                    visitors.clear()
                x = np.frombuffer(own_set.as_buffer(), "uint64").copy()
                if is_guest:
                    visitors.append((name, x))
                else:
                    here.append((name, x))
                    size += len(x)
                    if size > 500_000:
                        yield from meet()
                        size = 0
        yield from meet()
        release()

    parts = partitions(docs.sparkSession, n, 20_000)
    return dealt.repartition(parts, "home", "i", "j").sortWithinPartitions("home", "i", "j", F.desc("is_guest")).mapInArrow(run, "a long, b long")


def combinations(held: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, component, key, left) for the combinations of two frequent or three hot shingles of one group.

    held: doc_id, n, component, n_hot, cap, key, k, left.
    """
    needed = F.ceil(F.col("n") * percent / 100)
    levels = F.sequence(F.floor(F.log2(needed)), F.floor(F.log2("n")))
    groups = F.greatest(F.lit(1), F.floor((100 - percent) * F.pow(F.lit(2.0), F.col("level")) / (100 * GROUPED)))
    dealt = held.withColumn("level", F.explode(levels)).withColumn("groups", groups)
    dealt = dealt.withColumn("more", F.col("groups") + F.least(2 * F.col("groups"), F.col("n_hot")))
    dealt = dealt.filter(F.col("n") - F.col("left") < F.col("n") - needed + 1 + F.col("more"))
    lists = dealt.groupBy("doc_id", "n", "component", "cap", "level", "more", "k", F.pmod(F.xxhash64("key"), "groups").alias("group"))
    # In the order of all documents: what comes later leaves less to share.
    lists = lists.agg(F.sort_array(F.collect_set(F.struct("left", "key")), asc=False).alias("keys")).filter(F.size("keys") >= F.col("k"))

    def after(i: Column, make: Callable[[Column, Column], Column]) -> Column:
        return F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y, j: make(y, i + 1 + j))

    def key(last: Column, *others: Column) -> Column:
        return F.struct(F.xxhash64("level", *[x["key"] for x in others], last["key"]).alias("key"), F.least(last["left"] + F.col("more"), F.col("cap")).alias("left"))

    two = F.flatten(F.transform("keys", lambda x, i: after(i, lambda y, _: key(y, x))))
    three = F.flatten(F.flatten(F.transform("keys", lambda x, i: after(i, lambda y, j: after(j, lambda z, _: key(z, x, y))))))
    made = lists.select("doc_id", "n", "component", F.explode(F.when(F.col("k") == 2, two).otherwise(three)).alias("x"))
    return made.select("doc_id", "n", "component", "x.key", "x.left")


def similar_documents(docs: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", frequent: int = 32, hot: int = 65_536, most_frequent: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.  Links are pairs with 100 * both >= percent * either."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    size = plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = min(24, max(2, int(np.ceil(np.log2(max(size, 1) / 6 / 1_000_000 + 1)))))
    counts = stored(shingle_counts(plain, k, bits, frequent), "counts", gathered=True)
    known = counts.filter("n IS NOT NULL")
    held = spark.sparkContext.broadcast((*frequent_class(known, most_frequent), repeated_bitmap(counts, bits)))
    table = stored(signed(plain, k, percent, bits, hot, held), "signed", gathered=True)
    held.destroy()  # the table is written

    some = table.filter("n > 0 AND doc_id IS NOT NULL")
    whole = some.groupBy("n", "h", "g").agg(F.min("doc_id").alias("rep"))
    classes = stored(some.select("doc_id", "n", "h", "g").join(whole, ["n", "h", "g"]).select("doc_id", "rep", "n"), "classes")
    own = classes.filter("doc_id = rep").select("doc_id").distinct()
    reps = some.filter("size(keys) > 0").select("doc_id", "n", "n_hot", "cap", "keys").join(_sent(own, classes.count()), "doc_id", "left_semi")
    postings = reps.select("doc_id", "n", "n_hot", "cap", F.explode("keys").alias("x")).select("doc_id", "n", "n_hot", "cap", "x.*")
    many = known.filter(F.col("n") > SALTED).select("token", F.ceil(F.col("n") / SALTED).cast("int").alias("salts"))
    postings = postings.withColumn("token", F.shiftrightunsigned("key", 32 - bits)).join(F.broadcast(many) if many.count() < 100_000 else many, "token", "left").drop("token")
    place = Window.partitionBy("key", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)))
    postings = postings.withColumn("leader", F.min("doc_id").over(place)).withColumn("docs", F.count("*").over(place)).filter("docs > 1 OR salts > 1")
    postings = stored(postings.select("doc_id", "n", "n_hot", "cap", "key", "k", "left", "leader"), "postings")

    named = postings.filter("leader <> doc_id").groupBy("doc_id", "leader").agg(F.count("*").alias("votes"))
    best = named.groupBy("doc_id").agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("leader"))
    first = best.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    found = plain.filter("doc_id IS NOT NULL")
    links = stored(stars(found, first, k, percent), "links", gathered=True)

    groups = components(links)
    placed = postings.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    placed = stored(placed.join(open_, "key"), "open")
    single = placed.filter("k = 1").select("doc_id", "n", "component", "key", F.least("left", "cap").alias("left"))
    keys = stored(single.unionByName(combinations(placed.filter("k > 1"), percent)), "keys")
    linkable = stored(may_link(keys, percent), "linkable")
    pairs = stored(cross_pairs(linkable, percent), "pairs")
    members = placed.select("doc_id", "component").distinct()
    more = stored(visits(found, pairs, members, k, percent), "links", gathered=True)
    if linkable.filter(F.col("components") > FEW).head(1):
        more = more.unionByName(stored(crowds(found, linkable, keys, k, percent), "links", gathered=True))
    final = components(links.unionByName(more)).withColumnRenamed("node", "rep").withColumnRenamed("component", "c")
    ends = classes.select("doc_id", "rep").distinct().join(final, "rep", "left").select("doc_id", F.coalesce("c", "rep").alias("found"))
    out = table.select("doc_id", F.col("n").alias("n_shingles")).join(ends.groupBy("doc_id").agg(F.min("found").alias("found")), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
