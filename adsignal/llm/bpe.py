"""BPE encoding by speculation and verification, and decoding.

For every distinct word that a task has not met yet, greedy longest match proposes tokens.  A proposal is the true
encoding if no merge fires across any border of two neighbours, and that depends on the two tokens alone: a merge
(x, y) with x on the right spine of the left token and y on the left spine of the right one fires if it comes before
the merges that use up x and y.  All pairs of a batch that are not known yet are tested together on arrays; words with
a failing pair are merged exactly.

The text's way to words (special tokens, NFC, lower case, splitting) follows the tokenizer file's own settings for
vocabularies of this kind: byte-level letters, an end-of-word suffix, no decoder.

Defined cases: a null text is the empty one, with no ids; empty ids decode to the empty text; repeated rows are encoded
each; extra columns stay; a column that is named like an output is replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import _exact, default_path

CACHED_WORDS = 400_000  # of a worker; when there are more it begins anew
END = "</w>"
NEVER = np.int64(1) << 40

_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and signs that both Unicode tables are sure to agree on; texts with others take the library's way to words.
_PLAIN = [*range(0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in _PLAIN if unicodedata.category(chr(c))[0] in kinds)


_SPACE, _L, _N = "".join(map(chr, _SPACES)), _class("L"), _class("N")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")
_STRANGE = re.compile("[^" + "".join(map(chr, _PLAIN)).replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-") + "]")


class Vocabulary:
    """A tokenizer file's model, with each token's last merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.path, model = path, held["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.texts = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.texts[i] = token
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = _byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(merges)}
        n = len(self.texts)
        keys = np.array([a * n + b for a, b in self.ranks], "int64")
        order = np.argsort(keys)
        self.keys, self.key_ranks, self.n = keys[order], np.array([r for r, _ in self.ranks.values()], "int64")[order], n
        # Spines: for each token, on its right and left edge, the tokens that stood there and the merge that used each up.
        right: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        left: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.whole: dict[str, int] = {}
        for token, i in sorted(self.ids.items(), key=lambda x: (len(x[0]), x[1])):
            found, last = self._merge(self.start(token))
            if found == [i]:
                self.whole[token] = i
                right[i], left[i] = [(i, int(NEVER))], [(i, int(NEVER))]
                if last:
                    a, b, r = last
                    right[i] += [(t, min(u, r)) for t, u in right[b]]
                    left[i] += [(t, min(u, r)) for t, u in left[a]]
        deep = max(len(x) for x in [*right, *left])
        self.right, self.left = (np.array([[*x, *[(-1, -1)] * (deep - len(x))] for x in side], "int64") for side in (right, left))
        self.longest = max(len(t.removesuffix(END)) for t in self.whole)
        self.good, self.bad = np.empty(0, "int64"), np.empty(0, "int64")

    def start(self, token: str) -> list[int]:
        """Ids of a token's single letters; the end-of-word suffix belongs to the last one."""
        body = token.removesuffix(END) if len(token) > len(END) else token
        parts = list(body)
        if body != token:
            parts[-1] += END
        return [self.ids[p] for p in parts if p in self.ids]

    def _merge(self, ids: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        """Exact merging: the lowest rank first, the leftmost of equal ones; also the last merge made."""
        last, get, never = None, self.ranks.get, (1 << 40, -1)
        ids = list(ids)
        found = [get(p, never) for p in zip(ids, ids[1:], strict=False)]
        while found:
            lowest = min(found)
            if lowest is never:
                break
            i = found.index(lowest)
            last = ids[i], ids[i + 1], lowest[0]
            ids[i] = lowest[1]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), never)
        return ids, last

    def exact(self, word: str) -> list[int]:
        """Exact merging of a word; long ones by a heap of neighbours, in n log n steps, where ``_merge`` takes n * n."""
        ids = self.start(word + END)
        if len(ids) <= 200:
            return self._merge(ids)[0]
        get, n = self.ranks.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (found := get((a, b)))]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = get((a, b))[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (found := get((ids[left], ids[right]))):
                    heapq.heappush(waiting, (found[0], left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def speculate(self, word: str) -> list[int] | None:
        """Greedy longest match over tokens that stand for themselves; None where a letter is unknown."""
        out, at, n, whole = [], 0, len(word), self.whole
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                i = whole.get(word[at:end] + END if end == n else word[at:end])
                if i is not None:
                    break
            else:
                return None
            out.append(i)
            at = end
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether no merge fires across the border, for keys left * n + right."""
        a, b = pairs // self.n, pairs % self.n
        fires = np.zeros(len(pairs), bool)
        for i in range(self.right.shape[1]):
            for j in range(self.left.shape[1]):
                x, y = self.right[a, i], self.left[b, j]
                live = np.flatnonzero((x[:, 0] >= 0) & (y[:, 0] >= 0) & ~fires)
                if len(live):
                    key = x[live, 0] * self.n + y[live, 0]
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    rank = np.where(self.keys[at] == key, self.key_ranks[at], NEVER)
                    fires[live] = (rank < x[live, 1]) & (rank <= y[live, 1]) & (rank < NEVER)
        return ~fires

    def verify(self, proposals: list[list[int]]) -> np.ndarray:
        """For each proposal whether all its neighbours are compatible."""
        sizes = np.fromiter(map(len, proposals), "int64", len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), "int64", int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposals)), sizes)
        inner = owner[:-1] == owner[1:] if len(owner) else np.empty(0, bool)
        keys = (flat[:-1] * self.n + flat[1:])[inner] if len(owner) else np.empty(0, "int64")
        new = np.setdiff1d(keys, np.concatenate([self.good, self.bad]))
        if len(new):
            fine = self.compatible(new)
            self.good, self.bad = np.union1d(self.good, new[fine]), np.union1d(self.bad, new[~fine])
        ok = np.ones(len(proposals), bool)
        if len(self.bad) and len(keys):
            at = np.minimum(np.searchsorted(self.bad, keys), len(self.bad) - 1)
            ok[owner[:-1][inner][self.bad[at] == keys]] = False
        if len(self.good) + len(self.bad) > 4_000_000:
            self.good, self.bad = np.empty(0, "int64"), np.empty(0, "int64")
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in byte letters."""
        guesses = [self.speculate(w) if len(w) <= 1000 else None for w in words]
        ok = self.verify([g or [] for g in guesses])
        return [g if g is not None and fine else self.exact(w) for w, g, fine in zip(words, guesses, ok, strict=True)]

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens, before they are spelt in byte letters."""
        if _STRANGE.search(text):
            made = _exact(self.path)
            back = {c: b for b, c in enumerate(self.letters)}
            return [bytes(back[c] for c in w).decode("utf-8") for w, _ in made.pre_tokenizer.pre_tokenize_str(made.normalizer.normalize_str(text))]
        return _WORDS.findall(unicodedata.normalize("NFC", text).lower())

    def encode(self, texts: list[str], cache: dict[str, list[int]]) -> list[list[int]]:
        parts = []
        for text in texts:
            cut = self.cut.split(text) if self.cut and "<|" in text else [text]
            parts.append([self.split(x) if i % 2 == 0 else x for i, x in enumerate(cut)])
        if len(cache) > CACHED_WORDS:
            cache.clear()
        new = list({w for doc in parts for x in doc if isinstance(x, list) for w in x if w not in cache})
        letters = "".join(self.letters)
        spelt = [w if w.isascii() else w.encode("utf-8").decode("latin-1") for w in new]
        table = {b: letters[b] for b in range(256)}
        cache.update(zip(new, self.encode_words([w.translate(table) for w in spelt]), strict=True))
        return [list(chain.from_iterable(chain.from_iterable(map(cache.__getitem__, x)) if isinstance(x, list) else (self.special[x],) for x in doc)) for doc in parts]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def _cache(path: str) -> dict[str, list[int]]:
    return {}


def _appended(df: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    """df with a column that make(batch) gives for each Arrow batch."""
    before = df.drop(name)
    schema = T.StructType([*before.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != name]
                yield pa.RecordBatch.from_arrays([*columns, make(batch)], names=[f.name for f in batch.schema if f.name != name] + [name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with an array of token ids."""
    path = path or default_path("word_bpe_49k.json")

    def make(batch: pa.RecordBatch) -> pa.Array:
        found = vocabulary(path).encode([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], _cache(path))
        sizes = np.fromiter(map(len, found), "int64", len(found))
        values = np.fromiter(chain.from_iterable(found), "int32", int(sizes.sum()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))

    return _appended(df, ids, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of its ids: without a decoder in the file, the tokens joined by spaces."""
    path = path or default_path("word_bpe_49k.json")

    def make(batch: pa.RecordBatch) -> pa.Array:
        texts = vocabulary(path).texts
        held = batch.column(batch.schema.get_field_index(ids))
        return pa.array([" ".join(map(texts.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else "" for x in held], pa.string())

    return _appended(df, text, T.StringType(), make)


def digests(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return df.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
