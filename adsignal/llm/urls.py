"""URL filter: rules on host and path, and for the rest logistic regression on hashed character n-grams.

The regression is trained on the small labelled table of ``url_labels`` (or rows that the caller gives): the n-grams
of three to five characters of ``^host$`` and of ``^path$``, each hashed with its part's name into ``2 ** bits``
buckets, one weight for each.  The last label of a host (as ``com``) is left to the rules.

Defined cases: host and path are empty where the url is null or has no ``://``; those hold no n-gram and get the
verdict of the bias; urls of any length are read whole; repeated rows are judged alike; an empty table gives an empty
result; extra columns stay, but for those that are named like an output.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import url_labels

BITS = 16
ORDERS = (3, 4, 5)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def buckets(host_: str, path_: str, bits: int = BITS) -> list[int]:
    """The distinct buckets of a url's n-grams."""
    name = host_.rpartition(".")[0] or host_
    found = set()
    for part, text in (("h", name), ("p", path_)):
        if text:
            whole = f"^{text}$"
            found.update(zlib.crc32(f"{part}{whole[i : i + n]}".encode("utf-8", "replace")) % (1 << bits) for n in ORDERS for i in range(len(whole) - n + 1))
    return sorted(found)


def train(rows: list[tuple[str, str, int]], bits: int = BITS, rounds: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, 1 for block); full-batch gradient descent, the same every time.

    Both classes weigh the same, since the table's shares of them say nothing of the pages'.
    """
    weights, bias = np.zeros(1 << bits), 0.0
    sizes = [max(1, sum(y == k for _, _, y in rows)) for k in (0, 1)]
    held = [(buckets(h, p, bits), y, 1 / (2 * sizes[y])) for h, p, y in rows]
    for _ in range(rounds):
        gradient, shift = ridge * weights, 0.0
        for found, y, share in held:
            scale = 1 / np.sqrt(max(len(found), 1))
            miss = share * (1 / (1 + np.exp(-(bias + scale * weights[found].sum()))) - y)
            gradient[found] += miss * scale
            shift += miss
        weights -= rate * 20 * gradient
        bias -= rate * shift
    return weights, bias


#: Common beginnings of hosts and common paths, which say nothing of an address.
PLAIN = [("www.", "/"), ("m.", "/home"), ("blog.", "/archive"), ("", "/index.html"), ("", "/contact")]


def built_in() -> list[tuple[str, str, int]]:
    """The built-in table: each address as it is, and its bare host under the common beginnings and paths."""

    def cut(url: str) -> tuple[str, str]:
        rest = url.partition("://")[2].partition("?")[0].partition("#")[0]
        at = rest.find("/")
        return (rest, "") if at < 0 else (rest[:at], rest[at:])

    rows = [(*cut(u), y) for y, urls in ((1, url_labels.BLOCK), (0, url_labels.ALLOW)) for u in urls]
    bare = [(re.sub("^(www|m|blog)[.]", "", h), y) for h, _, y in rows]
    return rows + [(start + h, path, y) for h, y in bare for start, path in PLAIN]


def block_probability(host_: Column, path_: Column, rows: list[tuple[str, str, int]] | None = None, bits: int = BITS) -> Column:
    weights, bias = train(built_in() if rows is None else rows, bits)
    small = weights.astype(np.float32)

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            out = np.empty(len(hosts))
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                found = buckets(h.as_py(), p.as_py(), bits)
                z = bias + small[found].sum() / np.sqrt(max(len(found), 1))
                out[i] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.array(out)

    return run(host_, path_)


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as text, or null.  A rule: host, a slash, the start of the path."""
    choice = F.lit(None).cast("string")
    for rule in sorted((r for r, _ in rules), key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{rest}")
        choice = F.when(fits, F.lit(rule)).otherwise(choice)
    return choice


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages with ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``."""
    out = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = out.withColumn("block_score", block_probability(F.col("host"), F.col("path")))
    says = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    verdict = says
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    return out.withColumn("verdict", verdict)
