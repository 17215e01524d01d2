"""Personal data: four base kinds by pattern, and terms that give protected entities away.

Everything here is DataFrame functions.  A pattern's places come from the pieces between its matches, so they count
code points.  The patterns are written so that no run of letters or digits is scanned twice.

The method: an entity is the text of a base span.  Words and entities are counted by distinct whole texts, so that
copies of one document count once, wherever in a text they stand.  A word and an entity that share at least ``support``
texts (two: what only one text holds is shared with nothing) are judged by their pointwise mutual information,
log2(n(word, entity) * N / (n(word) * n(entity))).  A word whose information reaches ``bits`` and with which at least
``share`` of its texts hold the entity discloses it, and every occurrence of the word is a span of kind ``term``.  Words
and entities that can't reach the thresholds with any partner, by their own counts, are left out before pairs are made.
Sanitised text has ``[EMAIL]``, ``[IP]``, ``[CARD]`` and ``[PHONE]`` in place of base spans (generalised) and nothing in
place of terms (removed).

Defined cases: a null text is the empty one, without spans (its sanitised text stays null); empty tables give empty
results; repeated rows are judged alike, and copies of a document add no support; extra columns stay, but for columns
named like an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGIT_RUN = r"[0-9][0-9\x20-]{15,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")


def _placed(text: Column, pattern: Column, before: Column | None = None) -> Column:
    """(start, end, value) of every match, in order."""
    before = F.lit(0) if before is None else before
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        found = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(found)).alias("found"))

    kept = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.aggregate(kept, F.struct(before.alias("at"), none.alias("found")), step, lambda x: x["found"])


def _named(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _cards(text: Column) -> Column:
    """Runs of digits and single separators; a run of both is cut where two separators meet."""

    def cut(run: Column) -> Column:
        gaps, parts = F.regexp_extract_all(run["value"], F.lit(r"[\x20-]{2,}"), F.lit(0)), F.split(run["value"], r"[\x20-]{2,}", -1)
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")

        def step(done: Column, pair: Column) -> Column:
            bare = F.regexp_replace(pair["part"], r"[\x20-]+$", "")
            end = done["at"] + F.length(bare)
            found = F.struct(done["at"].alias("start"), end.alias("end"), bare.alias("value"))
            after = done["at"] + F.length(pair["part"]) + F.coalesce(F.length(pair["gap"]), F.lit(0))
            return F.struct(after.alias("at"), F.concat(done["found"], F.array(found)).alias("found"))

        return F.aggregate(F.arrays_zip(parts.alias("part"), gaps.alias("gap")), F.struct(run["start"].alias("at"), none.alias("found")), step, lambda x: x["found"])

    found = F.flatten(F.transform(_placed(text, F.lit(DIGIT_RUN)), cut))
    return F.filter(found, lambda s: F.length(_digits(s["value"])).between(16, 19) & _luhn(_digits(s["value"])))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> by kind, then start."""
    none = F.array().cast(SPAN)

    def part(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+(?=.)", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare.cast("int")).otherwise(999) <= 255)

    email = F.when(F.contains(text, F.lit("@")), _named("email", _placed(text, F.lit(EMAIL)))).otherwise(none)
    ip = F.when(text.rlike(IP), _named("ip", F.filter(_placed(text, F.lit(IP)), lambda s: F.forall(F.split(s["value"], r"\."), part)))).otherwise(none)
    card = F.when(text.rlike(DIGIT_RUN), _named("card", _cards(text))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), _named("phone", F.filter(_placed(text, F.lit(PHONE)), lambda s: F.length(_digits(s["value"])).between(8, 15)))).otherwise(none)
    return F.concat(email, ip, card, phone)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)


def judged(marked: DataFrame, support: int = 2, bits: float = 6.0, share: float = 0.5) -> DataFrame:
    """(word, entity, n_both, n_word, n_entity, information): marked has ``t`` and ``base``; see the module's text."""
    found = F.explode(F.concat(F.array(F.lit("")), F.array_distinct(words(F.col("t"))))).alias("word")  # every text holds the empty word
    kinds = marked.select("t").distinct().select(found).groupBy("word").agg(F.count("*").alias("n_word"))
    kinds = stored(kinds.filter((F.col("n_word") >= support) | (F.col("word") == "")), "words")
    total = (kinds.filter("word = ''").first() or {"n_word": 0})["n_word"]
    most = total / 2.0**bits * (1 + 1e-9)  # n_both is at most n_word and n_entity, so that neither can be more
    bearing = marked.filter(F.size("base") > 0).select("t", F.array_distinct(F.transform("base", lambda s: F.lower(s["value"]))).alias("entities")).distinct()
    bearing = stored(bearing.withColumn("text_id", F.monotonically_increasing_id()), "bearing")
    held = bearing.select("text_id", F.explode("entities").alias("entity"))
    entities = _listed(held.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity").between(support, most)), "entities")
    held = held.join(entities, "entity").groupBy("text_id").agg(F.collect_list(F.struct("entity", "n_entity")).alias("held"))
    texts = stored(bearing.join(held, "text_id").select(F.array_distinct(words(F.col("t"))).alias("words"), "held"), "held")
    near = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_near"))
    near = near.filter((F.col("n_near") >= support) & ~F.col("word").rlike("^[0-9]+$"))
    asked = _listed(near.join(kinds.filter((F.col("word") != "") & (F.col("n_word") <= most)), "word").filter(F.col("n_near") >= share * F.col("n_word")).select("word", "n_word"), "asked")
    pairs = texts.select(F.explode("words").alias("word"), "held").join(asked, "word").select("word", "n_word", F.explode("held").alias("e")).select("word", "n_word", "e.*")
    both = pairs.filter(~F.contains("entity", "word")).groupBy("word", "n_word", "entity", "n_entity").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    information = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_word") * F.col("n_entity")))
    return both.select("word", "entity", "n_both", "n_word", "n_entity", information.alias("information"))


def _listed(df: DataFrame, tag: str) -> DataFrame:
    df = stored(df, tag)
    return F.broadcast(df) if df.count() <= 200_000 else df  # beyond that size a shuffled join


def disclosing(marked: DataFrame, support: int = 2, bits: float = 6.0, share: float = 0.5) -> DataFrame:
    """(word): marked has ``t`` and ``base``; see the module's text."""
    scored = judged(marked, support, bits, share)
    return scored.filter((F.col("information") >= bits) & (F.col("n_both") >= share * F.col("n_word"))).select("word").distinct()


def find(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """docs with ``pii``: base spans by kind and start, then spans of kind ``term`` by start."""
    row = docs.withColumn("pii", base_spans(F.coalesce(F.col(text), F.lit(""))))
    terms = stored(disclosing(row.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col("pii").alias("base")), **thresholds), "terms")
    n = terms.count()
    if not n:
        return row
    listed = F.broadcast(terms) if n <= 200_000 else terms  # beyond that size a shuffled join
    key, mine = unused(row, "pii_key"), unused(row, "pii_terms")
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.xxhash64(whole).alias(key), F.explode(F.array_distinct(words(whole))).alias("word")).join(listed, "word").groupBy(key).agg(F.sort_array(F.collect_set("word")).alias(mine))
    own = stored(own, "own")
    held = own.agg(F.sum(F.size(mine))).first()[0] or 0
    own = F.broadcast(own) if held <= 500_000 else own  # beyond that size a shuffled join
    row = row.withColumn(key, F.xxhash64(whole)).join(own, key, "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(mine, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    term = F.when(F.col(mine).isNotNull(), _placed(whole, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return row.withColumn("pii", F.concat("pii", _named("term", term))).drop(key, mine)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span generalised or removed; of overlapping spans the first one's name stands for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        name = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.when(fresh, F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), name)).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    rest = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def sanitise(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """docs with their texts sanitised."""
    return find(docs, text, **thresholds).withColumn(text, replaced(F.col(text), F.col("pii"))).drop("pii")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    found = find(docs.select(key, text), text, **thresholds)
    counted = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [counted(kind) for kind in KINDS]
    base = F.filter("pii", lambda s: s["kind"] != "term")
    return found.select(key, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))
