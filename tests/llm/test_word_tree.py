"""The suffix tree over words against plain dictionaries, on the operators' fixture of odd, long and repeated texts."""

import collections
import contextlib
import functools
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import WORD, docs, lower, texts  # noqa: F401

from adsignal.llm import queries, suffix_tree, word_tree
from adsignal.llm.common import fold


def path(ws, at, depth):
    """The words before a place, last one first; the text's start counts as one."""
    return [*reversed(ws[max(0, at - depth) : at]), *(["<start>"] if at < depth else [])]


def tree_scores(held, out, depth=3, discount=0.85):
    """Each text's score, and all states by their contexts."""
    trained = [ws for i, ws in held.items() if not out[i]]
    c = collections.Counter(w for ws in trained for w in ws)
    n, once = sum(c.values()), sum(x == 1 for x in c.values())
    whole, rest_ = n / (n + once + 1), 1 - n / (n + once + 1)
    follows = collections.defaultdict(collections.Counter)
    for ws in trained:
        for at, w in enumerate(ws):
            before = path(ws, at, depth)
            for k in range(1, len(before) + 1):
                follows[tuple(before[:k])][w] += 1
    states = {}

    def given(before, w):
        mine, rest = 0, 1
        for k in range(1, len(before) + 1):
            if tuple(before[:k]) in states:
                after, total, share = states[tuple(before[:k])]
                mine, rest = (max(after[w] - discount, 0) / total if w in after else 0) + share * mine, rest * share
        return mine, rest

    for context in sorted(follows, key=len):
        after = follows[context]
        total, gain = sum(after.values()), 0
        for w, x in after.items():
            mine, rest = given(context[:-1], w)
            bits = min(15, int(np.log2(n / c[w]))) if c[w] * 2**15 >= n else 15
            gain += x * (np.log2(x / total) - (np.log2(mine) if mine else np.log2(rest) - bits))
        if gain > 0.5 * len(after) * np.log2(total):
            states[context] = after, total, discount * len(after) / total
    scores = {}
    for i, ws in held.items():
        scores[i] = 0
        for at, w in enumerate(ws):
            mine, rest = given(path(ws, at, depth), w)
            scores[i] += np.log10(mine) if mine else np.log10(rest * (whole * c[w] / n if c[w] else rest_))
    return scores, states, follows


@pytest.fixture(scope="module")
def wanted(docs):  # noqa: F811
    held = {i: [*WORD.findall(lower(t)), None] for i, t in texts(docs).items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in held}
    return held, *tree_scores(held, out)


def test_hashes_are_found():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype="uint64") * np.uint64(2))
        keys = np.unique(np.append(keys, suffix_tree.END_WORD)) if n > 1 else keys
        asked = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), np.array([0, 1, suffix_tree.END_WORD], "uint64")])
        assert (suffix_tree.Held(keys).find(asked) == suffix_tree.looked_up(asked, keys, np.arange(len(keys)), -1)).all()


def score(rows, **of):
    head = of.pop("head", 1 << 20)
    return suffix_tree.score_documents(rows, fold("doc_id", 7) != 2, fold("doc_id", 7) == 2, head=head, tree=functools.partial(word_tree.gains, **of))


@pytest.mark.parametrize("crowd, head", [(1 << 18, 1 << 20), (150, 50), (60, 1 << 20)])
def test_word_tree_is_that_of_dictionaries(spark, docs, wanted, crowd, head):  # noqa: F811
    """Whatever is crowded: words, runs of words, starts of texts; and whatever words are known to all tasks."""
    held, want, states, follows = wanted
    assert all(any(len(c) == k for c in states) for k in (1, 2, 3)) and len(states) < len(follows)
    assert sum(sum(a.values()) > 60 for c, a in follows.items() if len(c) == 3) > 5 and sum(follows["<start>",].values()) > 150
    rows = score(docs, crowd=crowd, head=head).collect()
    assert len(rows) == len(held)
    for r in rows:
        assert abs(r.score - want[r.doc_id]) < 1e-5 * abs(want[r.doc_id]) + 1e-5 + 1e-6 * r.n_tokens, r.doc_id


def test_a_common_word_is_a_context_and_shorter_ones_serve(spark):
    """what follows a common word is learnt, and a longer context never seen leaves the shorter one in use."""
    rows = [(i, f"the w{i % 3} of x{i} the y{i} ends") for i in range(300)] + [(1000, "novel of"), (1001, "of novel")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, new = ({r.doc_id: r.score for r in suffix_tree.score_documents(df, F.col("doc_id") < 1000, F.col("doc_id") >= 1000, tree=tree).collect()} for tree in (None, word_tree.gains))
    assert all(new[i] > old[i] + 5 for i in range(300))
    # After "ends" every text has ended, after "of" none; the word before was never seen.
    df = spark.createDataFrame([*rows, (1002, "novel ends")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in suffix_tree.score_documents(df, F.col("doc_id") < 1000, F.col("doc_id") >= 1000, tree=word_tree.gains).collect()}
    assert found[1002] > found[1000] + 0.5


def test_op9_predicts_held_out_texts(spark):
    """a tree in which each context is judged against its own suffix predicts far more than the root alone (-3.31)."""
    held, score_ = queries.op9_suffix_tree(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("n_tokens"), F.sum("score")).first()
    assert score_ / held > -2.6


def test_word_tree_without_training(spark, docs):  # noqa: F811
    of = {"tree": word_tree.gains}
    rows = suffix_tree.score_documents(docs.limit(20), F.lit(False), F.lit(True), **of).collect()
    assert len(rows) == 20 and all(r.n_known == 0 and r.score == 0 for r in rows)
    assert suffix_tree.score_documents(docs.limit(0), F.lit(True), F.lit(False), **of).count() == 0


def test_a_task_holds_little_beside_its_tokens(spark):
    """The check's finding of round 3 (executor memory): a million tokens in one task, packed, sent and judged."""
    psutil = pytest.importorskip("psutil")
    text = "concat_ws(' ', transform(sequence(1, 1000), i -> concat('w', pmod(xxhash64(id, i), 1000 * pmod(xxhash64(i, id), 50) + 1))))"
    texts_ = spark.range(1100).select(F.col("id").alias("h"), F.lit(True).alias("train"), F.expr(text).alias("t")).coalesce(1).localCheckpoint()
    counts = suffix_tree.word_counts(texts_).localCheckpoint()
    n = counts.agg(F.sum("n")).first()[0]
    found = counts.toPandas()
    order = np.argsort(found["key"].to_numpy().view("uint64"))
    most = found["key"].to_numpy().view("uint64")[order], found["n"].to_numpy()[order]
    peak, done = {}, threading.Event()

    def watch():
        while not done.wait(0.02):
            for p in psutil.Process().children(recursive=True):
                with contextlib.suppress(psutil.Error):
                    if "pyspark" in " ".join(p.cmdline()[1:]) and "java" not in p.name():
                        m = p.memory_info()
                        peak.setdefault(p.pid, [m.rss - m.shared]).append(m.rss - m.shared)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        rows = word_tree.gains(texts_, counts, n, 1100, n, (most[0][:0], most[1][:0]), most, True, (1 / n, -6.0)).count()
    finally:
        done.set()
        watcher.join()
    assert rows == 1100
    assert max(max(v) for v in peak.values()) < 190e6  # 151 MB; 233 while the words before each token were held beside it
