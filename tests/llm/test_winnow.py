"""Winnowing against every window of every document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from adsignal.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size):
    held = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in held}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    hit |= set(range(i, i + n))
                    found |= held[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def both(spark, docs, items, size=10, k=5, clash=()):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in clash})
    named = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in clash})
    rows = winnow.contamination(df, named, window=size, k=k).drop("spans").collect()
    assert sorted(map(tuple, rows), key=repr) == brute(docs, items, size)


@pytest.mark.parametrize(("size", "k"), [(10, 5), (4, 2), (3, 3), (6, 1)])
def test_every_shared_window_is_found(spark, size, k):
    draw = random.Random(size * 10 + k)
    text = lambda n: " ".join(draw.choice(["a", "b", "Étude", "été", "x1", "THE", "the"]) for _ in range(n))
    items = [(n, text(draw.choice([0, 1, 2, 5, 9, 10, 12, 40]))) for n in range(40)]
    items += [(3, text(12)), (None, text(11)), (None, text(4)), (90, None), (91, "--- !"), (92, items[7][1]), (92, items[7][1])]
    docs = [(n, text(draw.choice([0, 1, 5, 30, 200]))) for n in range(60)]
    docs += [(100 + n, f"{text(5)} {items[n % 40][1].upper()}, {text(5)}") for n in range(40)]
    docs += [(None, items[8][1]), (None, None), (5, ""), (5, " \n"), (6, "a " * 3000), (7, text(5000)), *[(8, docs[70][1])] * 30]
    both(spark, docs, items, size, k, clash=("h", "row", "near", "mark", "found", "item", "window", "length", "start"))


def test_spans_are_the_windows_found(spark):
    item = " ".join(f"w{n}" for n in range(12))
    docs = spark.createDataFrame([(1, f"before {item} behind {item.split(' ', 3)[3]}")], "doc_id long, text string")
    row = winnow.contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert [tuple(s) for s in row.spans] == [(1, 10), (2, 10), (3, 10)] and row.n_hit == 12 and row["items"] == "9"


def test_empty_tables_and_common_passages(spark):
    both(spark, [], [(1, "a b c")])
    both(spark, [(1, "a b c"), (2, None)], [])
    shared = " ".join(f"common{n}" for n in range(15))
    both(spark, [(n, f"{n} {shared} {n}") for n in range(400)], [(n, f"{shared} item{n}") for n in range(60)])


def test_a_table_beyond_the_broadcast_bound_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(winnow.met, "__defaults__", ("inner", 0, 4))
    draw = random.Random(1)
    items = [(n, " ".join(draw.choice("abc") for _ in range(14))) for n in range(20)]
    both(spark, [(n, f"{n} {items[n % 7][1]}") for n in range(50)], items)
