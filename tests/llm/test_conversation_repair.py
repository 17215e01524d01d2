"""Conversation repair against the enumeration of all edits, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from adsignal.llm import conversation_repair as repair

RIGHT = re.compile(r"(s?(ua)+)?")


def rows_after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """By trying all edits of up to the cost of deleting everything: (cost, audit, repaired rows)."""
    best = (3 * len(rows), "D" * len(rows), [])

    def go(i, cost, audit, made, roles):
        nonlocal best
        if cost > best[0] or not any(RIGHT.fullmatch(roles + end) for end in ("", "a", "ua")):
            return
        if i == len(rows) and RIGHT.fullmatch(roles) and (cost, audit) < best[:2]:
            best = (cost, audit, made)
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*made, (role, "")], roles + role[0])
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, cost + 3, audit + "D", made, roles)
            if kinds[i] not in ("blank", "duplicate"):
                late = kinds[i] == "truncated"
                go(i + 1, cost + late, audit + "K", [*made, (role, text)], roles + (role[:1] or "?"))
                for other in ("user", "assistant"):
                    go(i + 1, cost + 2 + late, audit + "R", [*made, (other, text)], roles + other[0])

    go(0, 0, "", [], "")
    return best


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = rows_after_damage([r for r in rows if r[0] == conv])
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, made = cheapest(own, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("kind", "fault", "edit", "place", "gone", "copy")})
    return sorted(map(tuple, repair.summarised(repair.repaired(repair.damaged(df))).collect()), key=repr)


def test_repair_is_the_cheapest_of_all_edits(spark):
    draw = random.Random(4)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "ufo"], ["Yes.", "No!", "What", " ", "", None, "é?\n", "End. "]
    rows = []
    for conv in range(150):
        usual = conv % 2 == 0
        for turn in range(draw.randrange(1, 6)):
            role = ("user", "assistant")[turn % 2] if usual and draw.random() < 0.7 else draw.choice(roles)
            rows.append((conv if conv else None, draw.choice([turn, turn, turn, turn * 3, None]), role, draw.choice(texts)))
    rows += [(500, None, None, None)] * 4 + [(501, 2, "user", "Same.")] * 3 + [(-5, 0, "system", "Only.")]
    # Conversations whose only row the damage takes away.
    gone = [n for n in range(600, 900) if zlib.crc32(f"{n}:1".encode()) % 20 == 0]
    assert gone
    rows += [(n, 1, "user", "Gone.") for n in gone]
    assert found(spark, rows) == brute(rows)


def test_edits_come_row_by_row(spark):
    rows = [(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 2, "assistant", "Three."), (1, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("gone", F.lit(False))
    edits = [(r.edit, r.was, r.role, r.text, r.fault) for r in repair.repaired(df).collect()]
    assert edits == [("K", "user", "user", "One.", None), ("I", None, "assistant", "", None), ("K", "user", "user", "Two.", None), ("K", "assistant", "assistant", "Three.", None), ("D", "assistant", "assistant", "", "blank")]


def test_survivors_meet_and_few_steps_are_held():
    draw, survivors, out, most = random.Random(2), repair.Survivors(), [], 0
    kinds = []
    for n in range(20_000):
        kinds.append((draw.choice("suax"), draw.random() < 0.1, draw.random() < 0.2))
        out += survivors.feed(*kinds[-1], n)
        most = max(most, n + 1 - len(out))
    out += survivors.finish()
    assert [row for _, row in out] == [*range(20_000), None] and most < 200
    # The same as with nothing given out before the end, by plain texts: six digits of cost, then edits.
    best = {repair.NOTHING: (0, "")}
    for kind in kinds[:3000]:
        after = {s: min((best[b][0] + c, best[b][1] + x) for b, c, x in w if b in best) for s, w in repair.WAYS[kind[0] if kind[0] != "x" else "", kind[1], kind[2]].items() if any(b in best for b, _, _ in w)}
        best = after
    whole = min((c + 2 * len(repair.ENDING[s]), e + repair.ENDING[s]) for s, (c, e) in best.items())
    again = repair.Survivors()
    short = [x for n, kind in enumerate(kinds[:3000]) for x in again.feed(*kind, n)] + list(again.finish())
    assert "".join(x for x, _ in short) == whole[1]


def test_ties_far_apart():
    """Two ways of equal cost whose edits part early and differ at once: the ASCII-least counts."""
    for middle in range(0, 60, 7):
        survivors = repair.Survivors()
        kinds = [("a", False, False), *[("u", False, False), ("a", False, False)] * middle, ("u", False, False)]
        made = "".join(x for n, k in enumerate(kinds) for x, _ in survivors.feed(*k, n)) + "".join(x for x, _ in survivors.finish())
        best = {repair.NOTHING: (0, "")}
        for kind in kinds:
            best = {s: min((best[b][0] + c, best[b][1] + x) for b, c, x in w if b in best) for s, w in repair.WAYS[kind].items() if any(b in best for b, _, _ in w)}
        assert made == min((c + 2 * len(repair.ENDING[s]), e + repair.ENDING[s]) for s, (c, e) in best.items())[1]


def test_long_conversations_long_texts_and_no_rows(spark):
    assert found(spark, []) == []
    long = "x" * 3_000_000 + "."
    rows = [(1, n, ("user", "assistant")[n % 2], long if n == 7 else f"Turn {n}.") for n in range(9000)]
    row = found(spark, rows)[0]
    assert row[0] == 1 and len(row[7].replace("I", "")) == len(rows_after_damage(rows)) and row[6] < 9000
