"""A probabilistic suffix tree over words: contexts of one to ``depth`` preceding words, each judged against its own suffix.

A text's start counts as a word before its first one, and no context reaches beyond it.  Whatever precedes a token, all
its contexts from the last word to the last ``depth`` ones are on one path of the tree, and the path is walked down:

* A context that training tokens follow is a state if the divergence of what follows it from what its longest shorter
  state (in the end the root) predicts, times its count, exceeds half a logarithm of the count for each distinct token
  that follows.  What the root predicts counts whole bits here, ``BITS`` at most.
* A state of count n gives a token that followed it m times (m - discount) / n, and shares the rest, discount * kinds / n,
  as its longest shorter state does; that one is looked up whether or not the contexts between are states.
* A token that followed no state of its path has its root probability times all the rests; for others what the root
  would add is left out, so that no text's score exceeds that of a distribution.

The subtree below a word is made in one task: each token of each text goes once, packed, with the words before it to the
bucket of its last word, where training tokens are counted, contexts judged, and all tokens scored.  A context that more
than ``crowd`` tokens follow is crowded.  What follows it is counted first, from sums of tasks; its tokens go to buckets of
its own by the word before (by the token where the context cannot be longer), and the counts of the context and of its
suffixes, which are crowded too, go along.  So no task holds more than some crowds, however common words or runs of them
are; a bucket in which several contexts of nearly a crowd meet is judged in shares, by the last word that tells contexts
apart.  ``crowd`` and the list of words known to all tasks change the work, never the scores.  Contexts are known by 64
bits.  Sums return by lots of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .shingles import lots, mixed, release
from .suffix_tree import BASE, BITS, END_WORD, SMALL, Held, _packed, _unpacked, looked_up, stream

NONE, BEGIN = np.uint64(0), np.uint64(1)  # instead of a word: nothing, the text's start
CROWD = 1 << 18
ASKED = 1 << 20  # tokens that a task packs together
SENT = 1 << 22  # bytes of packed tokens that a task sends at once
NAMES, TOKENS = 0, 100  # kinds of rows in a bucket; those between are the counts of a crowded context so long
ROWS = "bucket long, kind int, lot long, part binary"


class Words(NamedTuple):
    """The words that all tasks know: hashes in order, ranks, information; and those whose information is less than BITS."""

    keys: Held
    rank: np.ndarray
    bits: np.ndarray
    common: tuple[np.ndarray, np.ndarray]
    whole: bool  # all training words are among them

    def ids(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as numbers, by rank or else the hash itself, and information."""
        place = self.keys.find(key)
        other = np.flatnonzero(place < 0)
        if len(other) == len(key):
            return key.copy(), looked_up(key, *self.common, BITS).astype("uint8")
        ids, bits = self.rank[place].astype("uint64") + np.uint64(2), self.bits[place]
        ids[other], bits[other] = key[other], looked_up(key[other], *self.common, BITS)
        return ids, bits


class Crowds(NamedTuple):
    """Crowded contexts by hash, in order; where each one's own buckets begin, and how many they are."""

    hashes: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def find(self, context: np.ndarray) -> np.ndarray:
        return looked_up(context, self.hashes, np.arange(len(self.hashes)), -1)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, where each one is first, and each row's number of its hash: np.unique by a sort without indirection."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype="uint64")) & low).astype("int64")
    along = keys[order]
    new = np.concatenate([[True], along[1:] != along[:-1]]) if len(keys) else np.empty(0, bool)
    if (new[1:] & (along[1:] & ~low == along[:-1] & ~low)).any():  # hashes that differ in the low bits alone
        return np.unique(keys, return_index=True, return_inverse=True)
    number = np.empty(len(keys), "int64")
    number[order] = np.cumsum(new) - 1
    return along[new], order[new], number


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of contexts with one word more before them."""
    return mixed(context * BASE + mixed(word + BASE))


def lined(ids: np.ndarray, doc: np.ndarray, begins: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a line, each one after what precedes it, and the tokens' places; the words before one stand before it."""
    at = np.arange(len(ids)) + depth * (doc + 1)
    line = np.full(len(ids) + depth * len(begins), NONE)
    line[at] = ids
    line[at[begins] - 1] = BEGIN
    return line, at


def preceding(line: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The words before each token, the last one first."""
    return [line[at - back] for back in range(1, depth + 1)]


def dealt(word: np.ndarray, before: list[np.ndarray], crowds: Crowds, bucket_bits: int) -> np.ndarray:
    """The bucket of each token: that of its shortest context which is not crowded."""
    bucket = np.full(len(word), -1, "int64")
    open_, context, within = np.arange(len(word)), np.zeros(len(word), "uint64"), np.full(len(word), -1, "int64")
    for w in [*before, None]:
        ended = np.ones(len(open_), bool) if w is None else w[open_] == NONE
        context = np.where(ended, mixed(word[open_] + BASE), context if w is None else longer(context, w[open_]))
        crowd = np.where(ended, -1, crowds.find(context))
        done = crowd < 0
        own, spot = within[done], context[done]
        place = (spot >> np.uint64(64 - bucket_bits)).astype("int64")
        if len(crowds.hashes):
            place = np.where(own < 0, place, crowds.first[own] + (spot % crowds.size[np.maximum(own, 0)].astype("uint64")).astype("int64"))
        bucket[open_[done]] = place
        open_, context, within = open_[~done], context[~done], crowd[~done]
    return bucket


def _tokens(batches: Iterator[pa.RecordBatch], text: int, known: Words, depth: int):
    """For lots of a batch's texts: batch, first and last text, all words in a line, the tokens' places, information, texts."""
    for batch in batches:
        for first, last, data, ends in lots(batch.column(text), SMALL):
            key, doc, _, _, begins = stream(data, ends)
            ids, bits = known.ids(key)
            yield batch, first, last, *lined(ids, doc, begins, depth), bits, doc


def _added(word: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(word)
    word, n, bits = word[order], n[order], bits[order]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return word[starts], np.add.reduceat(n, starts), bits[starts]


def followed(texts: DataFrame, sent, contexts: list[tuple[int, ...]], hashes: np.ndarray, salts: np.ndarray, least: float) -> DataFrame:
    """(context, part, often): what follows crowded contexts of one length, in parts, and which words do so in a crowd."""
    depth = len(contexts[0])
    order = np.argsort(hashes)
    most = np.uint64(max(c[0] for c in contexts))  # of the numbers of contexts' last words, which are small

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            place, word, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            rows = []
            along = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[along], np.arange(len(contexts) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                some = along[cuts[i] : cuts[i + 1]]
                w, n, b = _added(word[some], np.ones(len(some), "int64"), bits[some])
                salt = (mixed(w) % np.uint64(salts[i])).astype("int64")
                for s in np.unique(salt).tolist():
                    rows.append((i, s, _packed(w[salt == s], n[salt == s].astype("uint32"), b[salt == s])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["context", "salt", "part"])

        for _, _, _, line, at, bits, _ in _tokens(batches, 0, sent.value, depth):
            likely = np.flatnonzero(line[at - 1] <= most)
            context = np.zeros(len(likely), "uint64")
            for w in preceding(line, at[likely], depth):
                context = longer(context, w)
            found = looked_up(context, hashes[order], order, -1)
            some = likely[found >= 0]
            if len(some):
                held.append((found[found >= 0], line[at[some]], bits[some]))
                size += len(some)
            if size > ASKED:
                yield flush()
                size = 0
        if size:
            yield flush()
        release()

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        word, n, bits = np.empty(0, "uint64"), np.empty(0, "int64"), np.empty(0, "uint8")
        for part in parts["part"]:
            w, m, b = _unpacked(part.as_py(), "uint64", "uint32", "uint8")
            word, n, bits = np.concatenate([word, w]), np.concatenate([n, m.astype("int64")]), np.concatenate([bits, b])
            if len(word) > ASKED:
                word, n, bits = _added(word, n, bits)
        word, n, bits = _added(word, n, bits)
        often = n > least
        release()
        return pa.table({"context": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([_packed(word, n, bits)], pa.binary()), "often": pa.array([word[often].tobytes() + n[often].tobytes()], pa.binary())})

    return texts.select("t").mapInArrow(count, "context long, salt long, part binary").groupBy("context", "salt").applyInArrow(add, "context long, part binary, often binary")


def _wide(of: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=size)


def scores(word: np.ndarray, before: list[np.ndarray], train: np.ndarray, bits: np.ndarray, crowded: list[tuple[np.ndarray, np.ndarray, np.ndarray]], discount: float) -> tuple[np.ndarray, np.ndarray]:
    """What a bucket's tokens have from the states of their paths, or 0; and the rest that the root shares.

    ``crowded``: words, counts and information of what follows the contexts that all tokens have, shortest first.
    """
    given, rest = np.zeros(len(word)), np.ones(len(word))
    tables = [np.zeros(len(w)) for w, _, _ in crowded]
    left = 1.0
    for level, (w, n, b) in enumerate(crowded):
        total, mine = n.sum(), tables[level]
        expected = np.where(mine > 0, np.log2(np.where(mine > 0, mine, 1)), np.log2(left) - b)
        if (n * (np.log2(n / total) - expected)).sum() > 0.5 * len(n) * np.log2(total):
            share = discount * len(n) / total
            for i in range(level + 1, len(crowded)):
                place = np.minimum(np.searchsorted(w, crowded[i][0]), len(w) - 1)
                tables[i] = np.where(w[place] == crowded[i][0], (n[place] - discount) / total, 0) + share * tables[i]
            place = np.minimum(np.searchsorted(w, word), len(w) - 1)
            given = np.where(w[place] == word, (n[place] - discount) / total, 0) + share * given
            left *= share
    rest *= left
    open_, context = np.arange(len(word)), np.zeros(len(word), "uint64")
    for w in before[len(crowded) :]:
        inside = w[open_] != NONE
        open_, context = open_[inside], longer(context[inside], w[open_[inside]])
        _, _, state = grouped(context)
        total = _wide(state, train[open_], 0)
        taught = total[state] > 0  # others, and all that are longer, are no states
        open_, context = open_[taught], context[taught]
        if not len(open_):
            break
        state = (np.cumsum(total > 0) - 1)[state[taught]]
        total = total[total > 0]
        _, one, edge = grouped(mixed(context * BASE + word[open_]))
        n, of = _wide(edge, train[open_], 0), state[one]
        seen = n > 0
        mine, left_ = given[open_[one]], rest[open_[one]]
        expected = np.where(mine > 0, np.log2(np.where(mine > 0, mine, 1)), np.log2(left_) - bits[open_[one]])
        gain = _wide(of[seen], n[seen] * (np.log2(n[seen] / total[of[seen]]) - expected[seen]), len(total))
        kinds = _wide(of[seen], np.ones(int(seen.sum())), len(total))
        kept = (gain > 0.5 * kinds * np.log2(total))[state]
        share = (discount * kinds / total)[state[kept]]
        to = open_[kept]
        given[to] = np.maximum(n[edge[kept]] - discount, 0) / total[state[kept]] + share * given[to]
        rest[to] *= share
    return given, rest


def gains(texts: DataFrame, counts: DataFrame, n_words: int, n_docs: int, n_all: int, common: tuple[np.ndarray, np.ndarray], most: tuple[np.ndarray, np.ndarray], whole: bool, weights: tuple[float, float], depth: int = 3, discount: float = 0.85, crowd: int = CROWD) -> DataFrame:
    """(h, gain, word): by the hash ``h`` of a text ``t``, what the tree adds to the root's score, from each copy of it;
    and for words that not all tasks know, but that followed a state, rows with the word, whose root score is not to count.

    ``train`` tells which texts teach; n_words and n_docs are these texts' tokens and number, n_all are all texts' tokens.
    """
    spark = texts.sparkSession
    rank = np.empty(len(most[0]), "int64")
    rank[np.argsort(-most[1], kind="stable")] = np.arange(len(rank))
    known = Words(Held(most[0]), rank.astype("uint32"), looked_up(most[0], *common, BITS).astype("uint8"), common, whole)
    sent_words = spark.sparkContext.broadcast(known)
    taught = texts.filter("train")
    least = crowd * max(n_words, 1) / max(n_all, 1)  # of training tokens, where others are as they are
    bucket_bits = min(20, max(5, int(np.ceil(np.log2(max(n_all, 1) / CROWD)))))

    # Crowded contexts: at most n_words / least of each length.
    found = counts.filter((F.col("n") > least) & (F.col("key") != -1)).toArrow()
    ids, _ = known.ids(found["key"].to_numpy().view("uint64"))
    end = int(known.ids(np.array([END_WORD]))[0][0])  # nothing follows it
    level = {(int(w),): int(n) for w, n in zip(ids, found["n"].to_numpy(), strict=True)} | ({(int(BEGIN),): n_docs} if n_docs > least else {})
    contexts: list[tuple[int, ...]] = []
    sizes: list[int] = []
    hashes = np.empty(0, "uint64")
    tables = []
    for length in range(1, depth + 1):
        if not level:
            break
        own = list(level)
        new = np.zeros(len(own), "uint64")
        for i in range(length):
            new = longer(new, np.array([c[i] for c in own], "uint64"))
        salts = np.array([int(n / least) + 1 for n in level.values()])
        parts = stored(followed(taught, sent_words, own, new, salts, least), "crowds")
        tables.append(parts.select((F.col("context") + len(contexts)).alias("context"), "part"))
        level = {}
        for row in parts.filter(F.length("often") > 0).select("context", "often").toLocalIterator():
            words_, n = np.frombuffer(row["often"], "uint64").reshape(2, -1)
            # A context ending in that word; its suffixes are crowded, too.
            level |= {(int(w), *own[row["context"]]): int(m) for w, m in zip(words_, n, strict=True) if int(w) != end}
        contexts, sizes, hashes = contexts + own, sizes + salts.tolist(), np.concatenate([hashes, new])
    first = (1 << bucket_bits) + np.cumsum([0, *sizes])[:-1].astype("int64")
    order = np.argsort(hashes)
    crowds = Crowds(hashes[order], first[order], np.array(sizes, "int64")[order])
    n_buckets = (1 << bucket_bits) + sum(sizes)
    sent = spark.sparkContext.broadcast((known, crowds))
    own_counts = spark.sparkContext.broadcast(most[1][np.argsort(rank)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, crowds = sent.value
        n_known = len(known.rank) + 2
        lines: list[np.ndarray] = []  # of words, each held once: those before a token are taken from it as pieces are packed
        held: list[tuple[np.ndarray, ...]] = []
        names: list[np.ndarray] = []
        size = n_docs = long = 0
        lot = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            line = np.concatenate(lines)
            lines.clear()
            bucket, at, doc, flags = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = bucket << 32
            order |= np.arange(len(bucket))
            order.sort()
            order &= 0xFFFFFFFF
            rows = [(lot % n_buckets, NAMES, np.concatenate(names).tobytes())]
            names.clear()
            along = bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], along[1:] != along[:-1]])) if len(along) else along
            packed = 0
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(along)], strict=False):
                some = order[a:b]
                place = at[some].astype("int64")
                rows.append((int(along[a]), TOKENS, _packed(doc[some], line[place], *preceding(line, place, depth), flags[some])))
                packed += len(rows[-1][2])
                if packed > SENT:
                    yield out(rows)
                    packed = 0
            if rows:
                yield out(rows)

        def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            b, kind, part = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(kind, pa.int32()), pa.array([lot] * len(b), pa.int64()), pa.array(part, pa.binary())], names=["bucket", "kind", "lot", "part"])

        for batch, a, b, line, at, bits, doc in _tokens(batches, 2, known, depth):
            flags = bits << np.uint8(1) | batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)[doc].astype("uint8")
            if known.whole:  # words never seen lead to no state
                some = line[at - 1] < n_known
                at, flags, doc = at[some], flags[some], doc[some]
            bucket = dealt(line[at], preceding(line, at, depth), crowds, bucket_bits)
            held.append((bucket, (at + long).astype("uint32"), (doc + n_docs).astype("uint32"), flags))
            lines.append(line)
            names.append(batch.column(0).slice(a, b - a).to_numpy())
            size, n_docs, long = size + len(at), n_docs + b - a, long + len(line)
            if size > ASKED:
                yield from flush()
                size = n_docs = long = 0
                lot += 1
        if names:
            yield from flush()
        release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.concatenate([[weights[1]] * 2, np.log10(weights[0] * np.maximum(own_counts.value, 1)), [weights[1]]])
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held_sums = 0
        now, tables, pieces = -1, {}, []

        def judged() -> Iterator[tuple[int, bytes]]:
            """Scores the bucket that was read; gives words that not all tasks know."""
            kinds = ["uint32", *["uint64"] * (depth + 1), "uint8"]
            cuts = np.cumsum([0, *(int.from_bytes(p[:8], "little") for _, p in pieces)])
            doc, word, *before, flags = columns = [np.empty(cuts[-1], kind) for kind in kinds]
            lots_ = [lot for lot, _ in pieces]
            for i in range(len(lots_)):
                for column, part in zip(columns, _unpacked(pieces[i][1], *kinds), strict=True):
                    column[cuts[i] : cuts[i + 1]] = part
                pieces[i] = None
            chain = []
            for level in sorted(tables):
                w, n, b = (np.concatenate(c) for c in zip(*(_unpacked(p, "uint64", "int64", "uint8") for p in tables[level]), strict=True))
                along = np.argsort(w)
                chain.append((w[along], n[along], b[along].astype("int64")))
            given, rest = np.empty(len(word)), np.empty(len(word))
            # A large bucket goes in shares by the word that tells its contexts apart.
            shares = len(word) // crowd + 1
            share = (mixed((word if len(chain) == depth else before[len(chain)]) + BASE) % np.uint64(shares)).astype("int64" if shares > 256 else "uint8")
            for k in range(shares):
                some = np.flatnonzero(share == k)
                w, words_ = word[some], [c[some] for c in before]
                same = w
                for c in words_:
                    same = longer(same, c)
                _, one, same = grouped(same)  # tokens that are equal up to all words before them are judged as one
                of_one = scores(w[one], [c[one] for c in words_], _wide(same, flags[some] & 1, len(one)), (flags[some[one]] >> 1).astype("int64"), chain, discount)
                given[some], rest[some] = (x[same] for x in of_one)
            hit = given > 0
            gain = np.where(hit, np.log10(np.where(hit, given, 1)) - root[np.minimum(word, len(root) - 1).astype("int64")], np.log10(rest))
            rare = hit & (word >= len(root) - 1)
            for i, lot in enumerate(lots_):
                s = slice(cuts[i], cuts[i + 1])
                own = doc[s]  # in order
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                sums.setdefault(lot, []).append((own[starts], np.add.reduceat(gain[s], starts)))
                if rare[s].any():
                    yield lot, doc[s][rare[s]].tobytes() + word[s][rare[s]].tobytes()

        def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            lot, kind, part = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lot, pa.int64()), pa.array(kind, pa.int32()), pa.array(part, pa.binary())], names=["lot", "kind", "part"])

        def summed() -> list[tuple[int, int, bytes]]:
            rows = []
            for lot, parts in sums.items():
                of, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                rows.append((lot, 1, _packed(of, _wide(place, np.concatenate([p[1] for p in parts]), 0).astype("float32"))))
            sums.clear()
            return rows

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held_sums
            if pieces:
                rows = [(lot, 2, part) for lot, part in judged()]
                held_sums += sum(len(x[-1][0]) for x in sums.values())
                if held_sums > 2 * ASKED:
                    rows += summed()
                    held_sums = 0
                if rows:
                    yield out(rows)
            tables.clear()
            pieces.clear()

        for batch in batches:
            for bucket, kind, lot, part in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                part = part.as_py()
                if bucket != now:
                    yield from closed()
                    now = bucket
                if kind == NAMES:
                    yield out([(lot, 0, part)])
                elif kind == TOKENS:
                    pieces.append((lot, part))
                else:
                    tables.setdefault(kind, []).append(part)
        yield from closed()
        if sums:
            yield out(summed())
        release()

    def returned(key: tuple, rows: pa.Table) -> pa.Table:
        kinds, parts = rows["kind"].to_pylist(), rows["part"]
        names = np.frombuffer(parts[kinds.index(0)].as_py(), "int64")
        total, others = np.zeros(len(names)), []
        for kind, part in zip(kinds, parts, strict=True):
            if kind == 1:
                of, gain = _unpacked(part.as_py(), "uint32", "float32")
                total[of] += gain
            elif kind == 2:
                held = np.frombuffer(part.as_py(), "uint8")
                n = len(held) // 12
                others.append((names[held[: 4 * n].view("uint32")], held[4 * n :].copy().view("int64")))
        h, words_ = (np.concatenate([np.empty(0, "int64"), *c]) for c in (zip(*others, strict=True) if others else ((), ())))
        release()
        return pa.table({"h": np.concatenate([names, h]), "gain": np.concatenate([total, np.zeros(len(h))]), "word": pa.array(np.concatenate([np.zeros(len(names), "int64"), words_]), mask=np.arange(len(names) + len(h)) < len(names))})

    rows = texts.select("h", "train", "t").mapInArrow(ask, ROWS)
    # A crowded context's counts go to its own buckets and to those of all longer crowded ones that end in it.
    number = {c: i for i, c in enumerate(contexts)}
    goes = [(number[c[:k]], k, b) for c, a, s in zip(contexts, first.tolist(), sizes, strict=True) for k in range(1, len(c) + 1) for b in range(a, a + s)]
    if goes:
        to = F.broadcast(spark.createDataFrame(goes, "context long, kind int, bucket long"))
        for table in tables:
            rows = rows.unionByName(table.join(to, "context").select("bucket", "kind", F.lit(0).cast("long").alias("lot"), "part"))
    parts = partitions(spark, n_buckets, 8)
    back = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, "lot long, kind int, part binary")
    out = stored(back.groupBy("lot").applyInArrow(returned, "h long, gain double, word long"), "answers")
    sent.destroy()  # the table is written
    own_counts.destroy()
    sent_words.destroy()
    return out
