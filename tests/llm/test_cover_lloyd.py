"""Product codes against plain Lloyd's rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adsignal.llm import cover_lloyd
from adsignal.llm.cover_lloyd import Quantiser, assign, cover_tree


def brute(rows, parts=4, entries=256, rounds=4):
    """rows (id, vector): kept rows' (id, code, error) and the codebooks, in Python's own numbers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = -(-max((len(x) for _, x in kept), default=0) // parts) * parts
    whole = [[math.floor(1024 * c) for c in x] + [0] * (length - len(x)) for _, x in kept]
    size, books, coded = length // parts, [], []
    for p in range(parts):
        own = [x[p * size : (p + 1) * size] for x in whole]
        book = own[:entries]
        nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), n) for n, y in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            given = {}
            for x in own:
                given.setdefault(nearest(x)[1], []).append(x)
            book = [[sum(c) // len(given[n]) for c in zip(*given[n], strict=True)] if n in given else y for n, y in enumerate(book)]
        coded.append([nearest(x) for x in own])
        books.append(book)
    found = [(kept[i][0], [c[i][1] for c in coded], sum(c[i][0] for c in coded)) for i in range(len(kept))]
    return sorted(found, key=repr), ",".join(str(c) for book in books for entry in book for c in entry)


def both(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("key", "x", "keys", "points", "error", "code")})
    found = Quantiser(df, "vec_id", "embedding", **settings)
    made = sorted(((r.key, list(r.code), r.error) for r in found.encode().collect()), key=repr)
    assert (made, found.text()) == brute(rows, **settings)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(cover_lloyd, "BLOCK", 64)


def test_rounds_are_exact(spark, small_blocks):
    draw = random.Random(3)
    rows = [(n, [draw.gauss(0, 1) for _ in range(8)]) for n in range(500)]
    rows += [(1000 + n, rows[n % 5][1]) for n in range(200)] + [(2000 + n, [x + draw.random() / 500 for x in rows[9][1]]) for n in range(150)]
    rows += [(3000, None), (3001, [math.nan] * 8), (3002, [1.0, None] * 4), (3003, [math.inf] + [0.0] * 7), (3004, []), (3005, [0.5]), (3006, [0.0] * 8)]
    rows += [(None, rows[2][1]), (None, [-1.0] * 8), (7, [0.25] * 8), (7, [0.25] * 8), (3007, [-0.0001] * 8)]
    draw.shuffle(rows)
    both(spark, rows, entries=20)
    both(spark, rows, entries=256, rounds=2)
    both(spark, rows, entries=5, parts=2, rounds=1)


def test_few_rows_ties_and_none(spark):
    both(spark, [])
    both(spark, [(1, None)])
    both(spark, [(1, []), (2, [])])
    both(spark, [(n, [float(n % 3), 1.0, -2.5]) for n in range(40)], entries=7)
    both(spark, [(n, [500.0 * (-1) ** n, 90_000.0, -7_000.25 * n, 3.0]) for n in range(30)], entries=4)


def test_components_beyond_the_limit(spark):
    df = spark.createDataFrame([(1, [1e30, -1e300]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = Quantiser(df, "vec_id", "embedding", entries=1, rounds=0).encode().collect()
    assert max(r.error for r in rows) < 1 << 63 and len(rows) == 2


def test_whole_subtrees_are_given_to_their_entry():
    draw = np.random.default_rng(5)
    centres = draw.integers(-900, 900, (6, 16))
    points = np.concatenate([c + draw.integers(-8, 9, (300, 16)) for c in centres] + [np.repeat(centres[:1], 200, axis=0)]).astype(np.int64)
    tree = cover_tree(points)
    compared, real = [], cover_lloyd._squares
    try:
        cover_lloyd._squares = lambda p, e: compared.append(len(p)) or real(p, e)
        codes, sums, counts = assign(points, tree, centres)
    finally:
        cover_lloyd._squares = real
    assert sum(compared) < len(points) / 20  # of 2,000 points, only centres of nodes were compared
    exact = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (codes == exact).all() and (counts == np.bincount(exact, minlength=6)).all()
    assert all((sums[n] == points[exact == n].sum(0)).all() for n in range(6))


def test_runs_and_radii_of_trees():
    points = np.random.default_rng(1).integers(-50, 50, (700, 4))
    tree = cover_tree(points)
    assert sorted(tree["order"].tolist()) == list(range(700))
    for n in range(len(tree["centre"])):
        run = tree["order"][tree["first"][n] : tree["last"][n]]
        away = np.sqrt(((points[run] - points[tree["centre"][n]]) ** 2).sum(1))
        kids = range(tree["kids_from"][n], tree["kids_to"][n])
        assert abs(away.max() - tree["radius"][n]) < 1e-9
        if kids:
            assert [int(tree["first"][k]) for k in kids] == [int(tree["first"][n]), *[int(tree["last"][k]) for k in kids][:-1]]
            assert all(tree["radius"][k] <= tree["radius"][n] / 2 for k in kids)


def test_codebooks_digest_of_the_query(spark):
    from adsignal.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    found = {r.vec_id: r for r in queries.op12_cover_lloyd(spark, "/root/testdata/sf0.001").collect()}
    coded, text = brute([(r.vec_id, r.embedding) for r in rows])
    labels = {r.vec_id: r.label for r in rows}
    sums = {}
    for key, _, error in coded:
        sums[labels[key]] = sums.get(labels[key], 0) + error
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert {k: (r.code, r.error, r.label_error, r.codebooks_sha256) for k, r in found.items()} == {k: ("".join(f"{c:02x}" for c in code), error, sums[labels[k]], digest) for k, code, error in coded}
