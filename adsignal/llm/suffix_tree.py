"""Language-model scores by a probabilistic suffix tree over words, with a second one over bytes for words never seen.

A text is its tokens: words with A-Z lower-cased, then one end.  The root of the tree is the distribution of all training
tokens and, as one class, of words never seen (as in the base score, so that the two scores measure the same event);
that class has as much as the tokens that occur once.

Contexts are of variable length: the shortest run of preceding words that holds at least log2(N) bits of information by
the words' own shares (N training tokens), so that chance alone would bring it about once; the text's start counts as a
word.  A run of ``depth`` words without that much information is no context.  A context is retained by a divergence
test: the tokens that follow it more than once must be predicted better, each without its own occurrence, than by the
root.  In a retained context c a token that followed it n > 1 times has probability n / (n(c) + 1), all others share
the rest in proportion to the root; without one the root serves.

What words of that class are called is scored beside it (``spelling``), by a tree over bytes: of the rarer training words every run of ``letters`` + 1 symbols is
counted, and a context of up to ``letters`` symbols is retained if its share of all symbols is at least ``least_share``
and the divergence of its next-symbol distribution from that of its own longest proper suffix, times its count, exceeds
half a logarithm of the count for each of its next symbols.  A distribution is smoothed by its suffix's one, the root by
a uniform one over bytes.  The two scores' sum is the probability of the text with all its spellings.

What is learnt grows with the corpus: contexts are counted in buckets and stay there, packed; texts send what follows
their contexts to the buckets, and get sums back by a hash of the text.  Sent to all tasks are only lists of bounded size:
words of at least 2 ** -15 of all tokens (no more than 2 ** 15 can be), at most ``head`` of the commonest words, the
spelling tree (least_share bounds it), and a bitmap of 16 MB that tells most contexts that are not retained.  ``head``
and the bitmap change the work, never the scores; every other word is joined.  A context is known by 28 bits beside its
bucket, a following token by 14 bits and its information.

Defined cases: a null text is the empty one, which is the end alone; repeated rows count each and are scored each; an
empty training set makes every token one never seen; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .jaccard_join import frequent_class
from .shingles import lots, mixed, release, words

END_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)
START = np.uint64(0x5851F42D4C957F2D)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE, END = 0x20, 0x0A
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
LANES = 2048
BITS = 15  # of information at most that one word counts for
SPELT = 12  # bits of information from which on a training word teaches spelling
SMOOTH = 1.0
LOT = 1 << 22  # tokens that a bucket holds in the mean; a task packs half as many together
SMALL, LETTERS = 1 << 17, 1 << 20  # bytes of text that are cut into words at once, and where each of a lot's words is spelt once
BITMAP_BITS = 27  # 16 MB
CONTEXT_BITS, NEXT_BITS = 28, 18  # of a context beside its bucket; of what follows: 14 of the word, 4 of its information


def stream(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of the documents: their hashes, documents and byte ranges, and each document's first token."""
    hashes, starts, stops, first = words(data, ends)
    counts = np.diff(first)
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) + len(counts)
    key, a, b = np.full(n, END_WORD), np.zeros(n, "int64"), np.zeros(n, "int64")
    key[at], a[at], b[at] = hashes, starts, stops
    return key, np.repeat(np.arange(len(counts)), counts + 1), a, b, np.cumsum(counts + 1) - counts - 1


def looked_up(key: np.ndarray, keys: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    """The values of keys in a sorted list, or another one."""
    if not len(keys):
        return np.full(len(key), other, "int64")
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[place] == key, values[place], other)


class Held:
    """Sorted, well-mixed hashes that are looked up by an index of their first bits, which each worker makes for itself."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(1, len(keys).bit_length())
        self.first: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"first": None}

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(key), -1, "int32")
        shift = np.uint64(64 - self.bits)
        if self.first is None:
            self.first = np.zeros((1 << self.bits) + 1, "int32")
            np.cumsum(np.bincount((self.keys >> shift).astype("int64"), minlength=1 << self.bits), out=self.first[1:])
        last = len(self.keys) - 1
        place = np.minimum(self.first[key >> shift], last)
        less = np.flatnonzero(self.keys[place] < key)
        while len(less):
            less = less[place[less] < last]
            place[less] += 1
            less = less[self.keys[place[less]] < key[less]]
        return np.where(self.keys[place] == key, place, np.int32(-1))


def contexts(key: np.ndarray, doc: np.ndarray, begins: np.ndarray, bits: np.ndarray, start_bits: int, need: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context as a hash, and whether it has one."""
    first = begins[doc]
    found, held, done = np.zeros(len(key), "uint64"), np.zeros(len(key), "int64"), np.zeros(len(key), bool)
    open_ = np.arange(len(key))
    for back in range(1, depth + 1):
        before = open_ - back
        inside = before >= first[open_]
        at_start = open_[~inside]
        found[at_start] = mixed(found[at_start] * BASE + START)
        done[at_start] = held[at_start] + start_bits >= need
        open_, before = open_[inside], before[inside]
        found[open_] = mixed(found[open_] * BASE + key[before])
        held[open_] += bits[before]
        full = held[open_] >= need
        done[open_[full]] = True
        open_ = open_[~full]
    return found, done


def spelling(data: np.ndarray, a: np.ndarray, b: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words data[a:b] as symbols, each after ``pad`` spaces and before one; where their letters begin and end."""
    lengths = b - a
    begins = np.cumsum(lengths + pad + 1) - lengths - 1
    out = np.full(int((lengths + pad + 1).sum()), SPACE, "uint8")
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(begins, lengths) + inside] = _LOWER[data[np.repeat(a, lengths) + inside]]
    return out, begins, begins + lengths + 1


class _Counter:
    """Counts of 64-bit keys, added lot by lot."""

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, "uint64"), np.empty(0, "int64")
        self.open: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.open.append(keys)
        self.size += len(keys)
        if self.size > max(1 << 20, len(self.keys)):
            self.close()

    def close(self) -> None:
        fresh, times = np.unique(np.concatenate([self.keys[:0], *self.open]), return_counts=True)
        keys, n = np.concatenate([self.keys, fresh]), np.concatenate([self.n, times])
        self.open, self.size = [], 0
        order = np.argsort(keys, kind="stable")  # two sorted runs are merged
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "int64")
        self.keys, self.n = keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.close()
        for at in range(0, len(self.keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[at : at + 100_000].view("int64")), pa.array(self.n[at : at + 100_000])], names=["key", "n"])
        self.__init__()


def _counted(texts: DataFrame, keys, lot: int) -> DataFrame:
    """(key, n): how often the keys of all texts ``t`` occur; a task gives what it has counted every few million keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for _, _, data, ends in lots(batch.column(0), lot):
                counter.add(keys(data, ends))
                if len(counter.keys) > 1 << 21:
                    yield from counter.rows()
        yield from counter.rows()
        release()

    return texts.select("t").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n): the tokens of texts ``t`` by hash."""
    return _counted(texts, lambda data, ends: stream(data, ends)[0], SMALL)


def spelling_counts(texts: DataFrame, letters: int, common) -> DataFrame:
    """(key, n): runs of letters + 1 symbols of the rarer words of texts ``t``."""

    def grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        key, _, a, b, _ = stream(data, ends)
        held, bits = common.value
        rare = np.flatnonzero((np.append(bits, BITS)[held.find(key)] >= SPELT) & (b > a))
        _, one, times = np.unique(key[rare], return_index=True, return_counts=True)  # each word is spelt once
        a, b = a[rare[one]], b[rare[one]]
        out, begins, stops = spelling(data, a, b, letters)
        code = np.zeros(max(0, len(out) - letters), "int64")
        for i in range(letters + 1 if len(code) else 0):
            code = (code << 8) | out[i : len(out) - letters + i]
        inside = np.zeros(len(out) + 1, "int64")
        inside[begins] += 1
        inside[stops] -= 1
        return np.repeat(code[np.cumsum(inside)[letters : len(out)] > 0].view("uint64"), np.repeat(times, b - a + 1))

    return _counted(texts, grams, LETTERS)


def retained(grams: DataFrame, depth: int, least_share: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each context length its retained contexts' rows: context, symbol, count."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    levels, parent = [], None
    for d in range(depth + 1):
        rows = grams.groupBy(F.expr(f"key & {(1 << (8 * (d + 1))) - 1}L").alias("key")).agg(F.sum("n").alias("n"))
        rows = rows.select(F.shiftright("key", 8).alias("context"), (F.col("key") % 256).cast("int").alias("symbol"), "n")
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter(F.col("total") >= max(1.0, least_share * total))
        rows = stored(rows.join(sums, "context"), "level")
        if d:
            suffix = F.expr(f"context & {(1 << (8 * (d - 1))) - 1}L")
            known = parent.select(F.col("context").alias("suffix"), "symbol", (F.col("n") / F.col("total")).alias("q"))
            share = F.col("n") / F.col("total")
            gains = rows.withColumn("suffix", suffix).join(known, ["suffix", "symbol"]).groupBy("context", "total", "kinds").agg(F.sum(F.col("n") * F.log(share / F.col("q"))).alias("gain"))
            kept = gains.filter(F.col("gain") > 0.5 * F.col("kinds") * F.log("total")).select("context")
            chosen = rows.join(kept, "context").select("context", "symbol", "n")
        else:
            chosen = rows.select("context", "symbol", "n")
        found = chosen.toArrow()  # at most 1 / least_share contexts
        levels.append((d, *(found[c].to_numpy().astype("int64") for c in ("context", "symbol", "n"))))
        parent = rows
    return levels


class Tree:
    """The automaton: for each state and symbol class, the next state and log10 of the symbol's probability."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], weight: float = 4.0):
        own: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for d, contexts, found, n in levels:
            order = np.argsort(contexts, kind="stable")
            contexts, found, n = contexts[order], found[order], n[order]
            cuts = [*np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])).tolist(), len(contexts)] if len(contexts) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own[int(contexts[a]).to_bytes(8, "big")[8 - d :] if d else b""] = found[a:b], n[a:b]
        seen = sorted({int(s) for s, _ in own.values() for s in s} | {SPACE, END})
        self.classes = np.full(256, len(seen), "int64")
        self.classes[seen] = np.arange(len(seen))
        self.width = len(seen) + 1  # the last class: bytes never seen
        states = sorted({c[:i] for c in own for i in range(len(c) + 1)} | {b""}, key=lambda c: (len(c), c))
        at = {c: i for i, c in enumerate(states)}
        self.next = np.zeros((len(states), self.width), "int32")
        probability = np.zeros((len(states), self.width))
        children: dict[int, list[tuple[int, int]]] = {}
        for c, i in at.items():
            if c:
                children.setdefault(at[c[:-1]], []).append((int(self.classes[c[-1]]), i))
        for c, i in at.items():
            fail = 0
            if c:
                fail = next(at[c[k:]] for k in range(1, len(c) + 1) if c[k:] in at)
                self.next[i] = self.next[fail]
            for symbol, child in children.get(i, ()):
                self.next[i, symbol] = child
            base = probability[fail] if c else np.full(self.width, 1 / 256)
            strength = weight if c else 256.0
            if c in own:
                found, n = own[c]
                counts = np.zeros(self.width)
                counts[self.classes[found]] = n
                probability[i] = (counts + strength * base) / (counts.sum() + strength)
            else:
                probability[i] = base
        self.log = np.log10(probability)

    def score(self, out: np.ndarray, depth: int) -> np.ndarray:
        """log10 of each symbol's probability; the first ``depth`` ones, which are padding, have no history."""
        lane = -(-len(out) // LANES)
        wide = np.full(depth + lane * LANES, SPACE, "uint8")
        wide[depth : depth + len(out)] = out
        starts = np.arange(LANES) * lane
        found = np.zeros((lane, LANES))
        state, next_, log = np.zeros(LANES, "int64"), self.next.ravel(), self.log.ravel()
        for step in range(depth + lane):
            place = state * self.width + self.classes[wide[starts + step]]
            if step >= depth:
                found[step - depth] = log[place]
            state = next_[place].astype("int64")
        return found.T.ravel()[: len(out)]


def _packed(numbers: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted numbers as steps, then other columns, each as planes of bytes, compressed."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = [np.ascontiguousarray(c.view("uint8").reshape(len(c), c.itemsize).T).tobytes() for c in (steps, *others)]
    return len(numbers).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, held = int.from_bytes(blob[:8], "little"), np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), "uint8")
    out, at = [], 0
    for i, kind in enumerate(kinds):
        width = np.dtype(kind).itemsize
        column = np.ascontiguousarray(held[at : at + n * width].reshape(width, n).T).view(kind).ravel()
        out.append(np.cumsum(column, dtype=kind) if i == 0 else column)
        at += n * width
    return out


def _codes(key: np.ndarray, context: np.ndarray, bits: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of contexts, and codes of a context (first) and what follows it."""
    low = (context >> np.uint64(64 - bucket_bits - CONTEXT_BITS)) & np.uint64((1 << CONTEXT_BITS) - 1)
    follows = ((key >> np.uint64(20)) & np.uint64((1 << (NEXT_BITS - 4)) - 1)) << np.uint64(4) | bits.astype("uint64")
    return (context >> np.uint64(64 - bucket_bits)).astype("int64"), low << np.uint64(NEXT_BITS) | follows


def _by_bucket(bucket: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, slice(cuts[b], cuts[b + 1])


def learnt(texts: DataFrame, sizes: tuple[int, int, int, int], common) -> DataFrame:
    """(bucket, states, bitmap): the retained contexts of texts ``t`` and what follows them, packed."""
    start_bits, need, depth, bucket_bits = sizes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            bucket, code = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            whole = np.sort(bucket.astype("uint64") << np.uint64(CONTEXT_BITS + NEXT_BITS) | code)
            starts = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
            n = np.diff(np.append(starts, len(whole))).astype("uint32")
            bucket, code = (whole[starts] >> np.uint64(CONTEXT_BITS + NEXT_BITS)).astype("int64"), whole[starts] & np.uint64((1 << (CONTEXT_BITS + NEXT_BITS)) - 1)
            made = [(b, _packed(code[s], n[s])) for b, s in _by_bucket(bucket, bucket_bits)]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], names=["bucket", "part"])

        for batch in batches:
            for _, _, data, ends in lots(batch.column(0)):
                key, doc, _, _, begins = stream(data, ends)
                bits = looked_up(key, *common.value, BITS)
                context, has = contexts(key, doc, begins, bits, start_bits, need, depth)
                if has.any():
                    held.append(_codes(key[has], context[has], bits[has], bucket_bits))
                    size += int(has.sum())
                if size > LOT // 2:
                    yield flush()
                    size = 0
        if size:
            yield flush()
        release()

    def judge(key: tuple, parts: pa.Table) -> pa.Table:
        columns = [_unpacked(p, "uint64", "uint32") for p in parts["part"].to_pylist()]
        code, n = np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns])
        columns.clear()
        order = np.argsort(code)
        code, n = code[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, n = code[starts], np.add.reduceat(n, starts).astype("int64")
        kept, _, _, more = _judged(code, n)
        low = code >> np.uint64(NEXT_BITS)
        piece = np.zeros(1 << (BITMAP_BITS - bucket_bits), "uint8")
        piece[(low[more] >> np.uint64(CONTEXT_BITS + bucket_bits - BITMAP_BITS)).astype("int64")] = 1
        release()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "states": pa.array([_packed(code[kept], n[kept].astype("uint32"))], pa.binary()), "bitmap": pa.array([np.packbits(piece).tobytes()], pa.binary())})

    return texts.select("t").mapInArrow(send, "bucket long, part binary").groupBy("bucket").applyInArrow(judge, "bucket long, states binary, bitmap binary")


def _judged(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted distinct codes and counts: which ones belong to a retained context (all its codes), each one's count of
    its context and of what follows that once, and which ones follow more than once, in a retained context."""
    low = code >> np.uint64(NEXT_BITS)
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    sizes = np.diff(np.append(starts, len(code)))
    again = n > 1
    total = np.add.reduceat(n, starts)
    single = np.add.reduceat(np.where(again, 0, n), starts)
    own = np.repeat(total, sizes)
    gain = np.add.reduceat(np.where(again, n * (np.log2(np.maximum(n - 1, 1) / (own - 1 + SMOOTH)) + (code & np.uint64(15)).astype("int64")), 0.0), starts)
    gain += single * np.log2((np.maximum(single - 1, 0) + SMOOTH) / (total - 1 + SMOOTH))
    kept = np.repeat((single < total) & (gain > 0), sizes)
    return kept, own, np.repeat(single, sizes), kept & again


def answered(texts: DataFrame, states: DataFrame, sizes: tuple[int, int, int, int], sent) -> DataFrame:
    """(h, gain, word): by the hash ``h`` of a text ``t``, what its contexts add to the root's score; and for words that
    are not in the head, but follow a context, rows with the word, whose own gain doesn't count there."""
    start_bits, need, depth, bucket_bits = sizes
    rows = "bucket long, is_query boolean, part binary, docs binary, words binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, head, _, weights, bitmap = sent.value
        held: list[tuple[np.ndarray, ...]] = []
        docs: list[np.ndarray] = []
        size = n_docs = 0

        def flush() -> pa.RecordBatch:
            bucket, code, doc, root, word, rare = (np.concatenate(x) for x in zip(*held, strict=True))
            names = np.concatenate(docs)
            held.clear()
            docs.clear()
            order = np.lexsort((code, bucket))
            bucket, code, doc, root, word, rare = (c[order] for c in (bucket, code, doc, root, word, rare))
            made = []
            for b, s in _by_bucket(bucket, bucket_bits):
                own, place = np.unique(doc[s], return_inverse=True)
                some = np.flatnonzero(rare[s])
                made.append((b, True, _packed(code[s], place.astype("uint32"), root[s]), names[own].tobytes(), some.astype("uint32").tobytes() + word[s][some].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[c.split()[0] for c in rows.split(", ")])

        for batch in batches:
            for first, last, data, ends in lots(batch.column(1)):
                key, doc, _, _, begins = stream(data, ends)
                bits = looked_up(key, *common, BITS)
                context, has = contexts(key, doc, begins, bits, start_bits, need, depth)
                spot = (context >> np.uint64(64 - BITMAP_BITS)).astype("int64")
                has &= ((bitmap[spot >> 3] >> (7 - (spot & 7)).astype("uint8")) & 1) == 1
                if has.any():
                    root, c = _root(key[has], head, weights)
                    held.append((*_codes(key[has], context[has], bits[has], bucket_bits), doc[has] + n_docs, root.astype("float32"), key[has], c == 0))
                    docs.append(batch.column(0).slice(first, last - first).to_numpy())
                    size, n_docs = size + int(has.sum()), n_docs + last - first
                if size > LOT // 4:
                    yield flush()
                    size = n_docs = 0
        if size:
            yield flush()
        release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, code, again, edge, rest, low = None, None, None, None, None, None
        for batch in batches:
            for bucket, is_query, part, docs, extra in zip(*(batch.column(i) for i in range(5)), strict=True):
                if not is_query.as_py():
                    at = bucket.as_py()
                    code, n = _unpacked(part.as_py(), "uint64", "uint32")
                    if len(code):
                        n = n.astype("int64")
                        _, own, single, again = _judged(code, n)
                        edge, rest, low = np.log10(n / (own + SMOOTH)), np.log10((single + SMOOTH) / (own + SMOOTH)), code >> np.uint64(NEXT_BITS)
                    continue
                if at != bucket.as_py() or not len(code):
                    continue
                asked, place, root = _unpacked(part.as_py(), "uint64", "uint32", "float32")
                names = np.frombuffer(docs.as_buffer(), "int64")
                spot = np.minimum(np.searchsorted(code, asked), len(code) - 1)
                follows = (code[spot] == asked) & again[spot]
                context = asked >> np.uint64(NEXT_BITS)
                state = np.minimum(np.searchsorted(low, context), len(low) - 1)
                gain = np.where(follows, edge[spot] - root, np.where(low[state] == context, rest[state], 0.0))
                sums = np.bincount(place, weights=gain, minlength=len(names))
                held = np.frombuffer(extra.as_buffer(), "uint8")
                n = len(held) // 12
                rare, word = held[: 4 * n].view("uint32"), held[4 * n :].copy().view("int64")
                out, some = follows[rare], np.flatnonzero(sums)
                columns = [(names[some], names[place[rare[out]]]), (sums[some], np.zeros(int(out.sum()))), (np.zeros(len(some), "int64"), word[out])]
                h, gain, last = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(gain), pa.array(last, mask=np.arange(len(h)) < len(some))], names=["h", "gain", "word"])
        release()

    asked = texts.select("h", "t").mapInArrow(ask, rows)
    none = F.lit(None).cast("binary")
    both = states.select("bucket", F.lit(False).alias("is_query"), F.col("states").alias("part"), none.alias("docs"), none.alias("words")).unionByName(asked)
    parts = partitions(texts.sparkSession, 1 << bucket_bits, 1)
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "is_query").mapInArrow(answer, "h long, gain double, word long")


def _root(key: np.ndarray, head: tuple[np.ndarray, np.ndarray], weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the tokens' probabilities by the root, those outside the head as if never seen; their counts, or 0."""
    each_whole, log_rest = weights
    c = looked_up(key, *head, 0)
    return np.where(c == 0, log_rest, np.log10(each_whole * np.maximum(c, 1) + (c == 0))), c


def score_documents(docs: DataFrame, training: Column, held_out: Column, key: str = "doc_id", text: str = "text", depth: int = 6, letters: int = 5, least_share: float = 1e-5, head: int = 1 << 20, tree: Callable[..., DataFrame] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelling.

    ``tree``: what adds to the root's score (``word_tree.gains``); by default one context a place, as said above."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"), held_out.alias("held_out"), training.alias("train"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    texts = plain.filter("train")
    counts = stored(word_counts(texts), "counts")
    n_words, n_kinds, n_once, n_docs = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.coalesce(F.sum(F.when(F.col("key") == -1, F.col("n"))), F.lit(0))).first()
    share_whole = n_words / (n_words + n_once + 1)  # the rest: tokens never seen (as many as seen once)
    each_whole, log_rest = share_whole / max(n_words, 1), float(np.log10(1 - share_whole))

    def by_key(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(tokens.view("uint64"))
        return tokens.view("uint64")[order], n[order]

    often = counts.filter(F.col("n") * (1 << BITS) >= n_words).toArrow()  # at most 2 ** BITS rows
    keys, n = by_key(*(often[c].to_numpy() for c in ("key", "n")))
    common = keys, np.log2(max(n_words, 1) / np.maximum(n, 1)).astype("int64").clip(0, BITS)
    most = by_key(*frequent_class(counts.select(F.col("key").alias("token"), "n"), head))
    indexed_common = send((Held(common[0]), common[1]))
    speller = Tree(retained(stored(spelling_counts(texts, letters, indexed_common), "spelling"), letters, least_share))
    indexed_common.destroy()  # the table is written
    held_common = send(common)
    bitmap, states, sizes = None, None, None
    if tree is None:
        bucket_bits = min(18, max(5, int(np.ceil(np.log2(max(n_words, 1) / LOT)))))
        start_bits = min(BITS, int(np.log2(max(n_words, 1) / max(n_docs, 1))))
        sizes = start_bits, int(np.ceil(np.log2(max(n_words, 2)))), depth, bucket_bits
        states = stored(learnt(texts, sizes, held_common), "states")
        bitmap = np.zeros(1 << (BITMAP_BITS - 3), "uint8")
        piece = len(bitmap) >> bucket_bits
        for row in states.select("bucket", "bitmap").toLocalIterator():  # 16 MB at any size of corpus
            bitmap[row["bucket"] * piece : (row["bucket"] + 1) * piece] = np.frombuffer(row["bitmap"], "uint8")
    sent = send((common, most, None, (each_whole, log_rest), bitmap) if tree is None else None)
    sent_head = send((Held(most[0]), np.append(np.log10(each_whole * most[1]), log_rest), np.append(np.log10(most[1] + 1.0), 0.0), speller))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, by_root, by_count, speller = sent_head.value
        for batch in batches:
            for first, last, data, ends in lots(batch.column(3), SMALL):
                own, doc, a, b, _ = stream(data, ends)
                place = head_words.find(own)  # -1, what is last, for others
                n_docs_ = last - first
                rare = np.flatnonzero(place < 0)
                rare = rare[np.lexsort((own[rare], doc[rare]))]
                words_, of = own[rare], doc[rare]
                out, begins, stops = spelling(data, a[rare], b[rare], letters)
                spelt = np.add.reduceat(np.append(speller.score(out, letters), 0.0), np.stack([begins, stops], axis=1).ravel())[::2] if len(rare) else np.empty(0)
                fresh = np.flatnonzero(np.concatenate([[True], (words_[1:] != words_[:-1]) | (of[1:] != of[:-1])])) if len(rare) else np.empty(0, "int64")
                times = np.diff(np.append(fresh, len(rare))).astype("int32")
                at = pa.array(np.searchsorted(of[fresh], np.arange(n_docs_ + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (words_[fresh].view("int64"), times, spelt[fresh])]
                part = batch.slice(first, n_docs_)
                sums = [np.bincount(doc, weights=w, minlength=n_docs_) for w in (by_count[place], by_root[place])]
                whole = [np.bincount(d, minlength=n_docs_) for d in (doc, doc[place >= 0])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, (*whole, *sums)), *lists], names=["doc_id", "held_out", "h", "n_tokens", "known", "sums", "score", "rare", "times", "spelt"])
        release()

    kind = docs.schema[key].dataType.simpleString()
    rows = plain.select("doc_id", "held_out", "h", "t").mapInArrow(run, f"doc_id {kind}, held_out boolean, h long, n_tokens long, known long, sums double, score double, rare array<long>, times array<int>, spelt array<double>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    if tree is None:
        found = stored(answered(plain, states, sizes, sent), "answers")
    else:
        n_all = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        found = tree(plain, counts, n_words, n_docs, n_all, common, most, len(most[0]) == n_kinds, (each_whole, log_rest))
    sent.destroy()  # both tables are written
    sent_head.destroy()
    held_common.destroy()

    whole_word = F.log10(F.lit(each_whole) * F.col("n")) - F.lit(log_rest)  # what a word learnt, but not in the head, adds
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times", "spelt")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"), F.col("x.spelt").alias("spelt"))
    known = rare.join(counts, "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum(F.col("times") * whole_word).alias("gained"), F.sum("times").alias("known_more"), F.sum(F.col("times") * F.col("spelt")).alias("needless"))
    gains = found.filter("word IS NULL").select("h", "gain").unionByName(found.filter("word IS NOT NULL").withColumnRenamed("word", "key").join(counts, "key").select("h", (-whole_word).alias("gain")))
    # Every copy of a text has sent the same.
    copies = rows.groupBy("h").agg(F.count("*").alias("copies"))
    gains = stored(gains.groupBy("h").agg(F.sum("gain").alias("gain")).join(copies, "h").select("h", (F.col("gain") / F.col("copies")).alias("by_context")), "gains")
    gains = F.broadcast(gains) if gains.count() <= 1_000_000 else gains  # 16 MB; beyond that a shuffled join
    each = float(np.log10(n_words + n_kinds + 1))
    spelt = F.aggregate(F.zip_with("times", "spelt", lambda n, x: n * x), F.lit(0.0), lambda total, x: total + x)
    out = rows.withColumn("spelling", spelt).drop("rare", "times", "spelt").join(known, "row", "left").join(gains, "h", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(int(n_words)).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("score") + F.coalesce("gained", F.lit(0.0)) + F.coalesce("by_context", F.lit(0.0))).alias("score"),
        (F.col("spelling") - F.coalesce("needless", F.lit(0.0))).alias("spelling"),
    )
