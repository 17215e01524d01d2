"""Labels from an ad's text by rules, row by row; only the brand catalog is joined.

Lexicons are arguments; those given here are small examples.  A term hits if the lower-cased text contains it, so
overlapping terms all count, each once.  Ties go to the lexicon's order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import lexicon_scores, term_hits
from ..functions.repeated import ID, once_each, written
from ..functions.similar import similar
from ..functions.sizes import sent_if_small
from ..functions.text import placed, product_name, slug_title, trimmed_name
from . import knowledge

REGIONS = {
    "QA": {"domain": [".qa"], "phone": ["+974"], "currency": ["qar"], "keyword": ["doha", "qatar", "قطر"]},
    "AE": {"domain": [".ae"], "phone": ["+971"], "currency": ["aed"], "keyword": ["dubai", "abu dhabi", "uae", "دبي"]},
    "SA": {"domain": [".sa"], "phone": ["+966"], "currency": ["sar"], "keyword": ["riyadh", "jeddah", "saudi"]},
}
WEIGHTS = {"domain": 8, "phone": 5, "currency": 3, "keyword": 2}
SCRIPTS = {"Chinese": r"一-鿿", "Japanese": r"぀-ヿ", "Korean": r"가-힯", "Cyrillic": r"Ѐ-ӿ"}
THEMES = {"price": ["discount", "% off", "save", "deal", "cheap"], "convenience": ["fast", "delivery", "easy", "order"], "quality": ["best", "fresh", "premium"], "variety": ["new", "choice", "menu"]}
VERTICALS = [("pharmacy", ["pharmacy", "medicine"]), ("fashion", ["fashion", "shoes"]), ("restaurant", ["food", "restaurant", "meal", "burger", "pizza"])]
AUDIENCES = {"Families": ["family", "kids"], "Students": ["student", "campus"], "Professionals": ["office", "business"]}
FOODS = {"Burgers": {"burger": 4.0, "fries": 2.0}, "Pizza": {"pizza": 4.0, "slice": 2.0}, "Mexican": {"taco": 4.0, "burrito": 4.0}, "Healthy": {"salad": 3.0, "acai": 4.0, "smoothie bowl": 4.0}, "Shawarma & Street Food": {"shawarma": 4.0, "شاورما": 4.0}}


def hits(text: Column, terms: list[str]) -> Column:
    """The distinct terms that the lower-cased text contains.  The text is lowered once, not for each term."""
    return F.transform(F.array(F.lower(text)), lambda low: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)))[0]


def hit_count(text: Column, terms: list[str]) -> Column:
    return F.size(hits(text, terms)) if terms else F.lit(0)


def _first_best(scores: dict[str, Column]) -> Column:
    """struct(name, score) of the largest score, the first named on ties."""
    rows = F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores.items())])
    return F.array_max(rows)


def scores(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """map<name, distinct hits>."""
    return F.create_map(*[x for n, terms in lexicon.items() for x in (F.lit(n), hit_count(text, terms))])


def region(text: Column, expected: str = "QA", regions: dict = REGIONS) -> Column:
    """struct(detected, confidence, signals, mismatches, is_valid); mismatches: the script, or other regions' terms."""
    text = F.coalesce(text, F.lit(""))
    city = F.lit(None).cast("string")
    for code, kinds in reversed(regions.items()):
        if code != expected:
            words = [k for k in kinds["keyword"]]
            found = F.lit(False)
            for w in words:
                found = found | (text.rlike(rf"(?iU)\b{w}\b") if w.isascii() else F.contains(text, F.lit(w)))
            city = F.when(found, code).otherwise(city)
    totals = {code: sum((F.lit(WEIGHTS[kind]) * (F.regexp_count(text, F.lit("|".join(t.replace("+", r"\+") for t in terms))) if kind == "phone" else hit_count(text, terms)) for kind, terms in kinds.items()), F.lit(0)) for code, kinds in regions.items()}
    found = {code: hits(text, sum(kinds.values(), [])) for code, kinds in regions.items()}
    return _region(text, expected, city, totals, found)


REGION_TERMS = "name string, part string, term string, place int"


def with_region(rows: DataFrame, key: str, text: str, terms: DataFrame, expected: str = "QA") -> DataFrame:
    """rows with ``region``, as ``region`` gives it, from a table of terms of any size (``REGION_TERMS``).

    ``part`` is domain, phone, currency or keyword; ``place`` orders regions and their terms.  A phone code counts as often
    as it occurs, other terms once.  Rows are told apart by ``key``.
    """
    table = terms.filter("term <> ''").groupBy("name", "part", "term").agg(F.min("place").alias("place")).withColumn("low", F.lower("term"))
    hits = term_hits(rows.select(key, text), text, table, "low").select(key, F.col("term").alias("low"), "n")
    met = hits.join(table, "low").join(rows.select(key, F.col(text).alias("t_")), key)
    word = F.when(F.octet_length("term") == F.length("term"), F.regexp("t_", F.concat(F.lit(r"(?iU)\b\Q"), F.col("term"), F.lit(r"\E\b")))).otherwise(F.contains("t_", "term"))
    found = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "name", "part", "low", "n", (word & (F.col("part") == "keyword")).alias("word")))).alias("found_"))
    out = rows.join(found, key, "left").withColumn("found_", F.coalesce("found_", F.array().cast("array<struct<place:int,name:string,part:string,low:string,n:bigint,word:boolean>>")))
    codes = [r["name"] for r in terms.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()]  # a few regions
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    of = lambda code: F.filter("found_", lambda x: x["name"] == code)
    totals = {c: F.aggregate(of(c), F.lit(0).cast("long"), lambda total, x: total + F.coalesce(F.try_element_at(weights, x["part"]), F.lit(0)) * F.when(x["part"] == "phone", x["n"]).otherwise(1)) for c in codes}
    city = F.lit(None).cast("string")
    for code in reversed([c for c in codes if c != expected]):
        city = F.when(F.exists(of(code), lambda x: x["word"]), code).otherwise(city)
    signals = {c: F.transform(of(c), lambda x: x["low"]) for c in codes}
    return out.withColumn("region", _region(F.coalesce(text, F.lit("")), expected, city, totals, signals)).drop("found_")


def _region(text: Column, expected: str, city: Column, totals: dict[str, Column], found: dict[str, Column]) -> Column:
    """The verdict from a foreign city, the regions' scores and their terms found."""
    script = F.lit(None).cast("string")
    for name, letters in reversed(SCRIPTS.items()):
        script = F.when(F.length(F.regexp_replace(text, f"[^{letters}]", "")) >= 3, name).otherwise(script)
    best = _first_best(totals)
    detected = F.when(script.isNotNull(), "INVALID").when(city.isNotNull(), city).when(best["score"] > 0, best["name"]).otherwise(expected)
    sure = F.when(script.isNotNull(), 0.98).when(city.isNotNull(), 0.95).when(best["score"] > 0, F.least(F.lit(0.98), 0.6 + best["score"] / 20)).otherwise(0.40)
    none = F.array().cast("array<string>")
    other = F.when(script.isNotNull(), F.array(script)).otherwise(F.concat(none, *[terms for code, terms in found.items() if code != expected]))
    return F.struct(detected.alias("detected"), F.round(sure, 3).alias("confidence"), F.concat(none, *found.values()).alias("signals"), F.when(detected == expected, none).otherwise(other).alias("mismatches"), (detected == expected).alias("is_valid"))


def only_region(text: Column, foreign: list[str]) -> Column:
    """False if any indicator of another region occurs."""
    return hit_count(F.coalesce(text, F.lit("")), foreign) == 0


@dataclass(frozen=True)
class OfferWords:
    """What offers are called, in plain words; a blank stands for any white space or none.

    An amount with a word of ``lower`` behind it, or of ``ahead`` before it, is taken off the price; ``swap`` has one
    number of pieces that are paid and one that are got.  The words given here are examples of two languages.
    """

    lower: tuple[str, ...] = ("off", "discount", "خصم")
    ahead: tuple[str, ...] = ("save", "خصم", "تخفيض")
    money: tuple[str, ...] = ("QAR", "AED", "SAR", "$", "ريال")
    no_fee: tuple[str, ...] = ("free delivery", "no delivery fee", "delivery on us", "توصيل مجاني")
    newcomer: tuple[str, ...] = ("first order", "new customer", "welcome offer", "عملاء جدد")
    ending: tuple[str, ...] = ("limited time", "today only", "ends soon", "لفترة محدودة")
    least_spent: tuple[str, ...] = ("min order", "minimum order", "orders above", "spend at least", "حد أدنى")
    swap: tuple[str, ...] = ("buy # get #", "b#g#", "bogo")
    fresh: tuple[str, ...] = ("new", "launch", "جديد")
    fresh_things: tuple[str, ...] = ("product", "item", "menu", "منتج")
    vague: tuple[str, ...] = ("special offer", "deal", "عرض")


OFFER_WORDS = OfferWords()


def _any_of(phrases: Iterable[str], number: str = r"\d+") -> str:
    """A pattern for phrases: blanks are optional, '#' is a number, and a word's letters don't follow other letters."""
    escaped = [r"\s*".join(re.escape(word).replace(r"\#", number) for word in phrase.split()) for phrase in phrases]
    return "(?:" + "|".join(rf"(?<![a-zA-Z]){e}" if p[0].isascii() and p[0].isalpha() else e for e, p in zip(escaped, phrases, strict=True)) + ")"


def offers(text: Column, words: OfferWords = OFFER_WORDS) -> Column:
    """array<struct(type, details, conditions, confidence, signals)>; the first is the primary one.

    Percentages and amounts give one entry a match; free delivery, two for one and a first order's discount give one
    each; general wording counts only where nothing else was found.
    """
    text = F.coalesce(text, F.lit(""))
    any_case = lambda pattern: "(?iU)" + pattern
    lower, ahead, money = _any_of(words.lower), _any_of(words.ahead), _any_of(words.money)
    of_newcomers, spent = text.rlike(any_case(_any_of(words.newcomer))), any_case(_any_of(words.least_spent) + r"\D{0,12}(\d+)")
    days = r"for\s*\d+\s*days?\s*only"
    minimum = F.regexp_extract(text, spent, 1)
    listed = F.filter(F.array(F.when(of_newcomers, "first order only"), F.when(minimum != "", F.concat(F.lit("min order QAR "), minimum)), F.when(text.rlike(any_case(f"{_any_of(words.ending)}|{days}")), "limited time")), lambda c: c.isNotNull())
    conditions = F.array_join(listed, "; ")
    kind = "array<struct<type:string,details:string,conditions:string,confidence:double,signals:array<string>>>"

    def one(name: str, details: Column, said: Column, sure: float, signal: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), details.alias("details"), said.alias("conditions"), F.lit(sure).alias("confidence"), F.array(signal).alias("signals"))

    def each(name: str, pattern: str, sure: float, form: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(any_case(pattern)), F.lit(1)), lambda m: one(name, F.format_string(form, m), conditions, sure, F.concat(F.lit(f"{name}:"), m))).cast(kind)

    def once(name: str, holds: Column, details: str, sure: float, said: Column = conditions) -> Column:
        return F.when(holds, F.array(one(name, F.lit(details), said, sure, F.lit(name))).cast(kind)).otherwise(F.array().cast(kind))

    found = F.concat(
        each("percentage_discount", rf"(\d+)\s*%\s*{lower}", 0.92, "%s%% off"),
        each("percentage_discount", rf"{ahead}\s*(\d+)\s*%", 0.92, "%s%% off"),
        each("fixed_discount", rf"{money}\s*(\d+)\s*{lower}", 0.90, "QAR %s off"),
        each("fixed_discount", rf"{ahead}\s*(\d+)\s*{money}", 0.90, "QAR %s off"),
        once("free_delivery", text.rlike(any_case(_any_of(words.no_fee))), "Free delivery", 0.95),
        once("bogo", text.rlike(any_case(_any_of(words.swap, r"(?:\d+|one)"))), "Buy one, get one offer", 0.88),
        once("first_order", of_newcomers, "First order discount", 0.85),
    )
    fresh = (hit_count(text, list(words.fresh)) > 0) & (hit_count(text, list(words.fresh_things)) > 0)
    vague = hit_count(text, list(words.vague)) > 0
    nothing = F.lit("")
    general = F.when(fresh, once("new_product", F.lit(True), "New product/menu item", 0.75, nothing)).otherwise(once("special_offer", vague, "Special offer (details unclear)", 0.60, nothing))
    none = once("none", F.lit(True), "", 0.95, nothing)
    return F.when(F.size(found) > 0, found).when(F.size(general) > 0, general).otherwise(none)


def vertical(text: Column, rules: list[tuple[str, list[str]]] = VERTICALS, fallback: str = "restaurant") -> Column:
    out = F.lit(fallback)
    for name, terms in reversed(rules):
        out = F.when(hit_count(text, terms) > 0, name).otherwise(out)
    return out


def themes(text: Column, offer_type: Column, lexicon: dict[str, list[str]] = THEMES, priced: tuple[str, ...] = ("percentage_discount", "fixed_discount", "bogo"), counts: dict[str, Column] | None = None) -> Column:
    """struct(scores map, primary, confidence): hits / 3 up to 1, price raised by an offer; confidence by the gap.

    ``counts`` are hits counted before, by ``counted``, for names of a table in place of the lexicon's.
    """
    counts = counts or {n: hit_count(F.coalesce(text, F.lit("")), t) for n, t in lexicon.items()}
    each = {n: F.least(F.lit(1.0), F.round(count / 3.0, 2) + (F.when(offer_type.isin(*priced), 0.3).otherwise(0.0) if n == "price" else F.lit(0.0))) for n, count in counts.items()}
    best = _first_best(each)
    ordered = F.sort_array(F.array(*each.values(), F.lit(0.0)), asc=False)
    gap = ordered[0] - ordered[1]
    return F.struct(F.create_map(*[x for n, s in each.items() for x in (F.lit(n), s)]).alias("scores"), best["name"].alias("primary"), F.when(gap >= 0.5, 0.95).when(gap >= 0.2, 0.85).otherwise(0.70).alias("confidence"))


def audience(text: Column, offer_type: Column, percent_off: Column, lexicon: dict[str, list[str]] = AUDIENCES, counts: dict[str, Column] | None = None) -> Column:
    """struct(segment, confidence): three points a keyword; else by offer; else the general audience."""
    points = {n: 3 * count for n, count in (counts or {n: hit_count(F.coalesce(text, F.lit("")), t) for n, t in lexicon.items()}).items()}
    best = _first_best(points)
    segment = F.when(best["score"] >= 3, best["name"]).when(offer_type == "first_order", "New Customers").when(percent_off >= 40, "Budget-Conscious").otherwise("General Audience")
    sure = F.when(best["score"] >= 3, F.least(F.lit(0.95), 0.70 + best["score"] / 30)).when(offer_type == "first_order", 0.88).when(percent_off >= 40, 0.75).otherwise(0.60)
    return F.struct(segment.alias("segment"), F.round(sure, 3).alias("confidence"))


def subscription(ads: DataFrame, catalog: DataFrame, text: str = "ad_text") -> DataFrame:
    """ads with subscription_name and subscription_confidence; catalog: advertiser_id, name, keywords, platform_terms, enabled."""
    joined = ads.join(sent_if_small(catalog), "advertiser_id", "left")
    has = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(t)))
    known, on = F.col("name").isNotNull(), F.coalesce("enabled", F.lit(False))
    both, key, platform = has(F.col("keywords")) & has(F.col("platform_terms")), has(F.col("keywords")), has(F.col("platform_terms"))
    general = F.lower(F.coalesce(F.col(text), F.lit(""))).rlike("subscription|membership")
    sure = F.when(known & on & both, 0.95).when(known & on & key, 0.30).when(known & on & platform, 0.20).when(known & on, 0.05).when(general, 0.15).otherwise(0.0)
    return joined.withColumn("subscription_name", F.when(known & on & both, F.col("name"))).withColumn("subscription_confidence", sure).drop("name", "keywords", "platform_terms", "enabled")


def food(text: Column, brand: Column, lexicon: dict[str, dict[str, float]] = FOODS, brands: dict[str, str] | None = None, least: float = 3.0, scored: dict[str, Column] | None = None) -> Column:
    """struct(category, confidence, score): weighted hits, 10 for a known brand; close seconds make it mixed."""
    text = F.coalesce(text, F.lit(""))
    own = F.create_map(*[F.lit(x) for p in (brands or {"Chipotle": "Mexican"}).items() for x in p])[brand]
    each = {name: score + F.when(own == name, 10.0).otherwise(0.0) for name, score in (scored or {}).items()}
    for name, terms in lexicon.items() if scored is None else ():
        weights = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
        score = F.aggregate(hits(text, list(terms)), F.lit(0.0), lambda total, t: total + weights[t])
        each[name] = score + F.when(own == name, 10.0).otherwise(0.0)
    ordered = F.sort_array(F.array(*each.values(), F.lit(0.0)), asc=False)
    best = _first_best(each)
    mixed = (ordered[1] >= least) & (ordered[1] / ordered[0] >= 0.7)
    category = F.when(best["score"] < least, None).when(mixed, "Mixed").otherwise(best["name"])
    return F.struct(category.alias("category"), F.round(F.when(best["score"] < least, 0.0).when(mixed, 0.80).otherwise(F.least(F.lit(0.95), 0.7 + best["score"] / 20)), 3).alias("confidence"), best["score"].alias("score"))


def food_first(text: Column, brand: Column, lexicon: dict[str, list[str]], brands: dict[str, str]) -> Column:
    """struct(category, confidence): the brand's category, else the first category with a hit."""
    out = F.struct(F.lit(None).cast("string").alias("category"), F.lit(0.0).alias("confidence"))
    for name, terms in reversed(lexicon.items()):
        n = hit_count(F.coalesce(text, F.lit("")), terms)
        out = F.when(n > 0, F.struct(F.lit(name).alias("category"), F.when(n >= 2, F.least(F.lit(0.92), F.lit(0.90))).otherwise(0.85).alias("confidence"))).otherwise(out)
    own = F.create_map(*[F.lit(x) for p in brands.items() for x in p])[brand]
    return F.when(own.isNotNull(), F.struct(own.alias("category"), F.lit(0.95).alias("confidence"))).otherwise(out)


FAMILIES = {"pharmacy": ["pharmacy", "medicine", "vitamin"], "beauty": ["makeup", "skincare", "perfume"], "flowers": ["flowers", "bouquet"], "entertainment": ["cinema", "tickets"], "sweets": ["chocolate", "cake"], "beverages": ["coffee", "juice"], "toys": ["toys", "games"], "pet": ["pet food", "dog food"]}


def product_type(text: Column, brand_type: Column, subscription_sure: Column, families: dict[str, list[str]] = FAMILIES, counts: dict[str, Column] | None = None) -> Column:
    """struct(type, confidence): the brand's type, families with two hits in order, subscription, then guesses."""
    text = F.coalesce(text, F.lit(""))
    device = text.rlike(r"(?iU)\b(phone|laptop|tablet|blender)\b")
    every = sum(counts.values(), F.lit(0)) if counts else hit_count(text, sum(families.values(), []))
    label = lambda name, sure: F.struct(F.lit(name).alias("type"), F.lit(sure).alias("confidence"))
    guess = F.when(every >= 2, label("unknown_category", 0.7)).when(every == 1, label("category_promotion", 0.6)).otherwise(label("restaurant", 0.4))
    out = F.when(subscription_sure >= 0.9, label("subscription", 0.9)).otherwise(guess)
    for name, count in reversed((counts or {n: hit_count(text, t) for n, t in families.items()}).items()):
        out = F.when(count >= 2, label(name, 0.85)).otherwise(out)
    out = F.when(brand_type.isNotNull(), F.struct(brand_type.alias("type"), F.lit(0.92).alias("confidence"))).otherwise(out)
    return F.when(device, F.struct(F.lit("electronics").alias("type"), F.lit(0.8).alias("confidence"))).otherwise(out)


LEXICON = "kind string, name string, term string, weight double, place int"


def counted(rows: DataFrame, key: str, text: str, lexicon: DataFrame) -> tuple[DataFrame, Callable[[str, str], dict[str, Column]]]:
    """Hits and scores of all names of a table of terms (``LEXICON``), in one pass however many terms there are.

    Returns the rows with a column ``counted``, and a function that gives, for a kind ('theme', 'audience', 'food',
    'family') and a measure (hits, score), the columns by name, in order of their least ``place``: what ``themes``,
    ``audience``, ``food`` and ``product_type`` take in place of their own lexicons.  Rows are told apart by ``key``.
    """
    entries = lexicon.select(F.concat_ws("\0", "kind", "name").alias("name"), "term", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    found = lexicon_scores(rows.select(key, text), [key], text, entries)
    maps = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("hits", "score")))).alias("counted"))
    # Names of labels: few, whatever the number of terms.
    names = [(r["kind"], r["name"]) for r in lexicon.groupBy("kind", "name").agg(F.min("place").alias("place")).orderBy("kind", "place", "name").collect()]

    def columns(kind: str, measure: str) -> dict[str, Column]:
        zero = F.lit(0).cast("long") if measure == "hits" else F.lit(0.0)
        return {n: F.coalesce(F.try_element_at("counted", F.lit(f"{k}\0{n}"))[measure], zero) for k, n in names if k == kind}

    return rows.join(maps, key, "left"), columns


def simple_label(offer_type: Column, brand: Column) -> Column:
    theme = F.when(F.coalesce(offer_type, F.lit("none")) == "none", "brand_awareness").otherwise(offer_type)
    return F.struct(theme.alias("primary_theme"), F.create_map(theme, F.lit(1.0)).alias("messaging_themes"), brand.alias("product_name"))


def fallback_label(text: Column, categories: dict[str, list[str]]) -> Column:
    category = F.lit("Meal Deals & Combos")
    for name, terms in reversed(categories.items()):
        category = F.when(hit_count(text, terms) > 0, name).otherwise(category)
    best = _first_best({n: hit_count(text, t) for n, t in THEMES.items()})
    return F.struct(category.alias("product_category"), F.when(best["score"] > 0, best["name"]).otherwise("convenience").alias("primary_theme"), F.lit(0.3).alias("confidence"))


def audit(type_: Column, food_category: Column, brand: Column, confidence: Column) -> Column:
    """Codes of what does not fit together."""
    rules = {"food without restaurant": food_category.isNotNull() & (type_ != "restaurant"), "restaurant without brand": (type_ == "restaurant") & brand.isNull(), "low confidence": confidence < 0.5}
    return F.filter(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]), lambda c: c.isNotNull())


MATCH = "struct<name:string,confidence:double,alias:string,source:string,entity_type:string,priority:int>"
TOKENS = r"[^\p{L}\p{N}]+"


def boosted(base: Column, start: Column, length: Column, times: Column) -> Column:
    """A confidence raised for an early place in the text and for repetition, at most .99."""
    share = start / F.greatest(length, F.lit(1))
    early = F.when(share <= 0.2, 0.05).when(share <= 0.4, 0.03).otherwise(0.0)
    return F.round(F.least(F.lit(0.99), base + early + F.least(F.lit(0.05), 0.02 * (times - 1))), 3)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKENS), lambda w: w != "")


def _runs(words: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many words."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[F.when(F.size(words) >= n, one(n)).otherwise(F.array().cast("array<string>")) for n in sizes]))


def brand_scan(ads: DataFrame, catalog: DataFrame, key: str, text: str = "ad_text", least: float = 0.86, ignored: tuple[str, ...] = ("platform",)) -> DataFrame:
    """(key, brand, alias, source, confidence, entity_type, priority): one row an ad and brand, the surest.

    catalog: canonical_name, alias, entity_type, priority.  An alias is found as whole words (.92, or .87 if it is not the
    brand's own name), else between signs that are no letters or digits (.85), else by a run of as many words whose
    similarity ratio is at least ``least`` (.75 and a quarter of what is over).  Aliases and texts meet on equal runs of
    words, and likely ones through an index of their segments, never all with all.  A text that several ads have is
    scanned once.
    """
    rows = ads.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))
    return once_each(rows, ["t"], lambda texts: _scanned(texts, catalog, ID, least, ignored), "inner").drop("t")


def _scanned(rows: DataFrame, catalog: DataFrame, key: str, least: float = 0.86, ignored: tuple[str, ...] = ("platform",)) -> DataFrame:
    """``brand_scan`` of rows (key, t), each scanned by itself.  Likely runs are written, so that texts are cut into runs
    twice: to find these, and to meet them and the catalog's own runs at once."""
    words = _tokens(F.col("alias"))
    known = catalog.filter(~F.col("entity_type").isin(*ignored)).select("canonical_name", "alias", "entity_type", "priority", F.array_join(words, " ").alias("run"), F.size(words).alias("size")).filter("size > 0").distinct()
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # how many words aliases have: a few numbers
    runs = rows.select(key, "t", F.explode(_runs(_tokens(F.col("t")), sizes)).alias("run"))
    size = lambda run: F.size(F.split(run, " "))
    likely = similar(runs.select(F.col("run").alias("text"), size("run").alias("kind")), known.select(F.col("run").alias("name"), F.col("size").alias("kind")), least)
    likely = written(likely, "likely").select(F.col("text").alias("likely"), F.col("name").alias("run"), "ratio")
    wanted = known.select(F.col("run").alias("likely"), "run", F.lit(None).cast("double").alias("ratio")).unionByName(likely)
    wanted = wanted.join(sent_if_small(known.drop("size")), "run").drop("run").withColumnRenamed("likely", "run").distinct()

    quoted = F.concat(F.lit(r"\Q"), F.col("alias"), F.lit(r"\E"))
    whole, between = F.concat(F.lit(r"(?iU)\b"), quoted, F.lit(r"\b")), F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9\u0600-\u06FF])"), quoted, F.lit(r"(?![A-Za-z0-9\u0600-\u06FF])"))
    equal, exact = F.col("ratio").isNull(), F.regexp("t", whole)
    met = runs.join(sent_if_small(wanted), "run").withColumn("exact", F.when(equal, exact))
    met = met.filter(~equal | F.col("exact") | (F.regexp("t", between) & (F.length("alias") >= 3)))
    pattern = F.when(F.col("exact"), whole).otherwise(between)
    base = F.when(~F.col("exact"), 0.85).when(F.lower("alias") == F.lower("canonical_name"), 0.92).otherwise(0.87)
    sure = boosted(base, F.regexp_instr("t", pattern) - 1, F.length("t"), F.regexp_count("t", pattern))
    direct = F.when(equal, F.struct(sure.alias("confidence"), F.when(F.col("exact"), "catalog").otherwise("catalog_substring").alias("source")))
    at = F.regexp_instr(F.lower("t"), F.concat(F.lit(r"(?U)\b\Q"), F.col("run"), F.lit(r"\E\b"))) - 1
    near = F.when(~equal, F.struct(F.greatest(at, F.lit(0)).alias("at"), "run", "ratio", F.length("t").alias("length")))
    # An alias that stands in the text is not looked for among the likely runs.
    found = met.groupBy(key, "canonical_name", "alias", "entity_type", "priority").agg(F.max(direct).alias("direct"), F.min(near).alias("x"))
    fuzzy = F.struct(boosted(0.75 + (F.col("x.ratio") - least) * 0.25, F.col("x.at"), F.col("x.length"), F.lit(1)).alias("confidence"), F.col("x.run").alias("alias"), F.lit("catalog_fuzzy").alias("source"))
    match = F.when(F.col("direct").isNotNull(), F.struct("direct.confidence", "alias", "direct.source")).otherwise(fuzzy)
    found = found.select(key, "canonical_name", match.alias("m"), "entity_type", "priority")
    best = found.groupBy(key, F.col("canonical_name").alias("brand")).agg(F.max(F.struct("m.confidence", "m.alias", "m.source", "entity_type", "priority")).alias("x"))
    return best.select(key, "brand", "x.alias", "x.source", "x.confidence", "x.entity_type", "x.priority")


#: Examples, to be replaced by a market's own lists: words at which a name in a sentence ends, and words of no name.
NAME_ENDS = ["and", "at", "for", "in", "is", "now", "on", "online", "the", "to", "today", "with", "your"]
NO_NAMES = ["meal", "meals", "deal", "deals", "offer", "offers", "shop", "sale", "new", "free", "delivery"]
SAID = r"(?U)\b(?i:(?:shop|order|buy|available|delivered|delivery)\s+(?:online\s+)?from|at|by|from)\s+(\p{Lu}[\p{L}'&.-]*(?:\s+[\p{L}'&.-]+){0,5})"
TITLE = r"(?U)\b\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+){0,2}\b"
ARABIC = r"[\u0600-\u06FF]{3,}(?:\s+[\u0600-\u06FF]{3,})*"
SLUG = r"https?://[^/\s]+/[A-Za-z-]+/([a-z0-9-]+)"


def _possible_names(text: Column, hints: Column) -> Column:
    """All names and words of a text, in lower case, that a rule may look up in the catalog."""
    said = F.transform(placed(text, SAID, 1), lambda m: trimmed_name(F.regexp_replace(m["value"], r"[.,;!?-]+$", ""), [*NAME_ENDS, *NO_NAMES]))
    slugs = F.transform(placed(text, SLUG, 1), lambda m: slug_title(m["value"]))
    phrases = F.transform(placed(text, TITLE), lambda m: m["value"])
    whole = F.concat(said, slugs, phrases, F.transform(placed(text, ARABIC), lambda m: F.trim(m["value"])), F.coalesce(hints, F.array().cast("array<string>")))
    words = F.flatten(F.transform(phrases, lambda p: F.split(p, r"\s+")))
    return F.array_distinct(F.transform(F.filter(F.concat(whole, words), lambda n: n.isNotNull()), lambda n: F.lower(n)))


def _listed(rows: DataFrame, catalog: DataFrame, key: str, text: str) -> DataFrame:
    """rows with ``listed`` and ``platforms``: which of the names that a row may hold are the catalog's, and platforms'."""
    names = catalog.select(F.explode(F.array(F.lower("canonical_name"), F.lower("alias"))).alias("name"), F.when(F.col("entity_type") == "platform", F.lower("canonical_name")).alias("platform"))
    names = names.groupBy("name").agg(F.coalesce(F.bool_or(F.col("platform") == F.col("name")), F.lit(False)).alias("is_platform"))
    asked = rows.select(key, F.explode(_possible_names(F.coalesce(text, F.lit("")), F.col("hinted_brands"))).alias("name"))
    found = asked.join(names, "name").groupBy(key).agg(F.collect_set("name").alias("listed"), F.collect_set(F.when(F.col("is_platform"), F.col("name"))).alias("platforms"))
    none = F.array().cast("array<string>")
    return rows.join(found, key, "left").withColumn("listed", F.coalesce("listed", none)).withColumn("platforms", F.coalesce("platforms", none))


def unknown_brands(text: Column, known: Column | None = None, catalog: list[str] | Column | None = None, platforms: list[str] | Column | None = None, stop: list[str] = NAME_ENDS, generic: list[str] = NO_NAMES) -> Column:
    """array<struct(name, confidence, source)> of names that no catalog has found, each once, in the order of the rules:
    'order from X' (.90), the slug of a marketplace link (.72), phrases of capitals (.68), Arabic phrases (.70).

    ``known`` are names found before; ``catalog`` and ``platforms`` are lists, or columns of lower-case names.  Single words count only where the catalog has them; phrases with general words,
    platforms and names of two letters don't count.
    """
    kind = "array<struct<name:string,confidence:double,source:string>>"
    text = F.coalesce(text, F.lit(""))
    names, other = _column(catalog), _column(platforms)
    within = lambda word, words: F.array_contains(words if isinstance(words, Column) else _column(words), F.lower(word))
    several = lambda name: (F.size(F.split(name, r"\s+")) > 1) | within(name, names)
    plain = lambda name: ~F.exists(F.split(F.lower(name), r"\s+"), lambda w: within(w, generic) | within(w, other))

    def form(pattern: str, group: int, base: float, source: str, name: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
        found = F.transform(placed(text, pattern, group), lambda m: F.struct(name(m["value"]).alias("name"), boosted(F.lit(base), m["start"], F.length(text), F.lit(1)).alias("confidence"), F.lit(source).alias("source")))
        return F.filter(found, lambda m: m["name"].isNotNull() & (F.length(m["name"]) > 2) & (F.length(m["name"]) <= 50) & ~within(m["name"], other) & keep(m["name"])).cast(kind)

    said = form(SAID, 1, 0.90, "said", lambda v: trimmed_name(F.regexp_replace(v, r"[.,;!?-]+$", ""), [*stop, *generic]), several)
    slug = form(SLUG, 1, 0.72, "link", slug_title, lambda name: ~within(name, generic))
    phrase = form(TITLE, 0, 0.68, "phrase", lambda v: v, lambda name: several(name) & plain(name))
    arabic = form(ARABIC, 0, 0.70, "arabic", F.trim, lambda name: ~within(name, generic))
    done = F.transform(F.coalesce(known, F.array().cast("array<string>")) if known is not None else F.array().cast("array<string>"), lambda n: F.lower(n))

    def add(state: Column, m: Column) -> Column:
        seen = F.array_contains(state["seen"], F.lower(m["name"]))
        return F.when(seen, state).otherwise(F.struct(F.concat(state["seen"], F.array(F.lower(m["name"]))).alias("seen"), F.concat(state["rows"], F.array(m)).alias("rows")))

    start = F.struct(done.alias("seen"), F.array().cast(kind).alias("rows"))
    return F.aggregate(F.concat(said, slug, phrase, arabic), start, add, lambda state: state["rows"])


def _column(names: list[str] | Column | None) -> Column:
    """Lower-case names as one array."""
    return names if isinstance(names, Column) else F.array(*[F.lit(n.lower()) for n in names or []]).cast("array<string>")


def with_hints(matches: Column, hints: Column, catalog: list[str] | Column | None = None) -> Column:
    """struct(matches, inferred, conflict): hinted brands rise by .12; without one, the first hint is added (.82 if the
    catalog has it, else .75).  conflict: another brand is as sure as .8.  matches: array<struct(name, confidence, ...)>.
    """
    hints = F.coalesce(hints, F.array().cast("array<string>"))
    kind = "array<struct<name:string,confidence:double,hinted:boolean>>"
    hinted = lambda m: F.exists(hints, lambda h: F.lower(h) == F.lower(m["name"]))
    raised = F.transform(matches, lambda m: F.struct(m["name"].alias("name"), F.when(hinted(m), F.round(F.least(F.lit(0.99), m["confidence"] + 0.12), 3)).otherwise(m["confidence"]).alias("confidence"), hinted(m).alias("hinted"))).cast(kind)
    missing = (F.size(hints) > 0) & ~F.exists(matches, hinted)
    others = F.exists(matches, lambda m: ~hinted(m) & (m["confidence"] >= 0.8))
    first = F.try_element_at(hints, F.lit(1))
    listed = F.array_contains(_column(catalog), F.lower(first))
    added = F.array(F.struct(first.alias("name"), F.when(listed, 0.82).otherwise(0.75).alias("confidence"), F.lit(True).alias("hinted"))).cast(kind)
    return F.struct(F.when(missing, F.concat(raised, added)).otherwise(raised).alias("matches"), missing.alias("inferred"), ((F.size(hints) > 0) & others).alias("conflict"))


def ranked(matches: Column) -> Column:
    """Matches in order: hinted first, then priority, confidence, length of the name, the name itself."""
    order = F.transform(matches, lambda m: F.struct(m["hinted"].alias("hinted"), m["priority"].alias("priority"), m["confidence"].alias("confidence"), F.length(m["name"]).alias("n"), m["name"].alias("name")))
    return F.transform(F.sort_array(order, asc=False), lambda m: m["name"])


#: How product types are called as categories.
CATEGORIES = {"restaurant": "Specific Restaurant/Brand Promo", "unknown_category": "Consumer Electronics", "service": "Platform Subscription Service", "grocery": "Grocery Delivery", "pharmacy": "Pharmacy & Health"}
OTHER_CATEGORY = "Meal Deals & Combos"


def brands_of(ads: DataFrame, catalog: DataFrame, key: str, text: str = "ad_text", hints: DataFrame | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ads with ``brand``, ``brand_confidence``, ``brand_type``, ``brand_inferred``, ``brand_conflict``.

    Catalog first; ``resolve`` (key, text -> key, brand, confidence) is asked for ads of which the catalog knows nothing,
    and for no others; then names that no catalog has, then hints (advertiser_id, brands).  What is equal in all of these
    is worked out once.
    """
    own, told = [text, *(["advertiser_id"] if hints is not None else [])], []
    if resolve is not None:
        known = brand_scan(ads, catalog, key, text).select(key).distinct()
        asked = resolve(ads.join(known, key, "left_anti").select(key, text))
        stored = sent_if_small(catalog.select("canonical_name", "entity_type", "priority").distinct())
        found = asked.join(stored, F.col("brand") == F.col("canonical_name"), "left").select(key, F.struct(F.col("brand").alias("name"), "confidence", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.coalesce("priority", F.lit(-1)).alias("priority")).alias("m"))
        ads, told = ads.join(found.groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("told")), key, "left"), ["told"]
    labelled = lambda rows: _branded(rows, catalog, ID, text, hints).select(ID, "brand", "brand_confidence", "brand_type", "brand_inferred", "brand_conflict")
    return once_each(ads, [*own, *told], labelled).drop(*told)


def _branded(ads: DataFrame, catalog: DataFrame, key: str, text: str, hints: DataFrame | None) -> DataFrame:
    """``brands_of`` of rows that are each looked at by themselves; ``told``, if they have it, is what a resolver said."""
    none = F.array().cast("array<struct<name:string,confidence:double,entity_type:string,priority:int>>")
    found = _scanned(ads.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")), catalog, key).select(key, F.struct(F.col("brand").alias("name"), "confidence", "entity_type", "priority").alias("m"))
    listed = found.groupBy(key).agg(F.collect_list("m").alias("m"))
    rows = ads.join(listed, key, "left").withColumn("m", F.sort_array(F.concat(F.coalesce("m", none), F.coalesce("told", none) if "told" in ads.columns else none)))
    if hints is not None:
        rows = rows.join(sent_if_small(hints.select("advertiser_id", F.col("brands").alias("hinted_brands"))), "advertiser_id", "left")
    else:
        rows = rows.withColumn("hinted_brands", F.lit(None).cast("array<string>"))
    few = catalog.select("canonical_name", "alias", "entity_type").distinct().limit(MOST_NAMES + 1).collect()
    if len(few) <= MOST_NAMES:  # written into the plan; a larger catalog is joined with the names that texts hold
        names = [n for r in few for n in (r["canonical_name"], r["alias"])]
        rows = rows.withColumn("listed", _column(sorted(set(names)))).withColumn("platforms", _column(sorted({r["canonical_name"] for r in few if r["entity_type"] == "platform"})))
    else:
        rows = _listed(rows, catalog, key, text)
    others = F.transform(unknown_brands(F.col(text), F.transform("m", lambda m: m["name"]), F.col("listed"), F.col("platforms")), lambda m: F.struct(m["name"].alias("name"), m["confidence"].alias("confidence"), F.lit("unknown").alias("entity_type"), F.lit(-1).alias("priority")))
    rows = rows.withColumn("m", F.concat("m", others)).withColumn("h", with_hints(F.col("m"), F.col("hinted_brands"), F.col("listed")))
    full = F.transform("h.matches", lambda m: F.struct(m["name"].alias("name"), m["confidence"].alias("confidence"), m["hinted"].alias("hinted"), F.coalesce(F.try_element_at(F.transform(F.filter("m", lambda x: x["name"] == m["name"]), lambda x: x["priority"]), F.lit(1)), F.lit(1)).alias("priority")))
    rows = rows.withColumn("full", full).withColumn("brand", F.try_element_at(ranked(F.col("full")), F.lit(1)))
    first = lambda array, field: F.try_element_at(F.transform(F.filter(array, lambda x: x["name"] == F.col("brand")), lambda x: x[field]), F.lit(1))
    rows = rows.withColumn("brand_confidence", first("full", "confidence")).withColumn("brand_type", first("m", "entity_type"))
    return rows.withColumn("brand_inferred", F.col("h.inferred")).withColumn("brand_conflict", F.col("h.conflict")).drop("m", "h", "full", "hinted_brands", "listed", "platforms", "told")


#: Names that are written into a plan; what they give is the same as by a join.
MOST_NAMES = 500
NO_CATALOG = "canonical_name string, alias string, entity_type string, priority int"
NO_SUBSCRIPTIONS = "advertiser_id string, name string, keywords array<string>, platform_terms array<string>, enabled boolean"
NO_KNOWLEDGE = "product_name string, product_type string, confidence double"


def enrich(ads: DataFrame, key: str = "ad_id", text: str = "ad_text", expected: str = "QA", catalog: DataFrame | None = None, subscriptions: DataFrame | None = None, hints: DataFrame | None = None, known: DataFrame | None = None, resolve: Callable[[DataFrame], DataFrame] | None = None, lexicon: DataFrame | None = None, regions: dict | DataFrame = REGIONS, words: OfferWords = OFFER_WORDS) -> DataFrame:
    """The whole chain: region, subscription, brand, product type, knowledge, food, offers, audience, themes, name.

    Ads of a wrong region go no further: their labels are null.  ads: key, text, advertiser_id.  ``lexicon`` (``LEXICON``)
    takes the place of the examples of themes, audiences, foods and families; a kind that it lacks keeps them.
    ``regions`` is a dict like the example's or a table (``REGION_TERMS``).  Ads of one advertiser with one text are
    labelled once, unless there is a ``resolve``, which is asked by key.
    """
    if resolve is None:
        labelled = lambda rows: _enriched(rows, ID, text, expected, catalog, subscriptions, hints, known, None, lexicon, regions, words)
        return once_each(ads.select(key, text, "advertiser_id"), [text, "advertiser_id"], labelled).drop(text, "advertiser_id")
    return _enriched(ads, key, text, expected, catalog, subscriptions, hints, known, resolve, lexicon, regions, words)


def _enriched(ads: DataFrame, key: str, text: str, expected: str, catalog: DataFrame | None, subscriptions: DataFrame | None, hints: DataFrame | None, known: DataFrame | None, resolve: Callable[[DataFrame], DataFrame] | None, lexicon: DataFrame | None, regions: dict | DataFrame, words: OfferWords) -> DataFrame:
    spark = ads.sparkSession
    empty = lambda found, kind: spark.createDataFrame([], kind) if found is None else found
    rows = ads.select(key, text, "advertiser_id")
    rows = with_region(rows, key, text, regions, expected) if isinstance(regions, DataFrame) else rows.withColumn("region", region(F.col(text), expected, regions))
    kept = rows.filter("region.is_valid").select(key, text, "advertiser_id")
    kept = subscription(kept, empty(subscriptions, NO_SUBSCRIPTIONS), text)
    kept = brands_of(kept, empty(catalog, NO_CATALOG), key, text, hints, resolve) if resolve is not None else _branded(kept, empty(catalog, NO_CATALOG), key, text, hints)
    own = lambda kind, measure="hits": None
    if lexicon is not None:
        kept, columns = counted(kept, key, text, lexicon)
        own = lambda kind, measure="hits": columns(kind, measure) or None
    kept = kept.withColumn("type", product_type(F.col(text), F.when(F.col("brand_type") != "unknown", F.col("brand_type")), F.col("subscription_confidence"), counts=own("family")))
    kept = kept.withColumn("product_type", F.col("type.type")).withColumn("confidence", F.col("type.confidence"))
    kept = knowledge.gate(kept, empty(known, NO_KNOWLEDGE))
    kept = kept.withColumn("offer", offers(F.col(text), words)[0]).withColumn("food", food(F.col(text), F.col("brand"), scored=own("food", "score")))
    kept = kept.withColumn("off", F.regexp_extract("offer.details", r"(\d+)%", 1).try_cast("int"))
    kept = kept.withColumn("themes", themes(F.col(text), F.col("offer.type"), counts=own("theme"))).withColumn("audience", audience(F.col(text), F.col("offer.type"), F.col("off"), counts=own("audience")))
    eats = F.when(F.col("product_type") == "restaurant", F.col("food.category"))
    kept = kept.withColumn("food_category", eats).withColumn("product_category", F.coalesce(F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p])[F.col("product_type")], F.lit(OTHER_CATEGORY)))
    kept = kept.withColumn("product_name", product_name(F.col("brand"), F.col("food_category"), F.col("product_category"), F.col("subscription_name")))
    sure = F.filter(F.array("brand_confidence", "confidence", "offer.confidence", "audience.confidence"), lambda x: F.coalesce(x, F.lit(0.0)) > 0)
    labels = kept.select(
        key,
        "product_category",
        "product_name",
        "product_type",
        F.col("source").alias("type_source"),
        "food_category",
        "brand",
        "brand_inferred",
        "brand_conflict",
        "subscription_name",
        F.col("offer.type").alias("offer_type"),
        F.col("offer.details").alias("offer_details"),
        F.col("offer.conditions").alias("offer_conditions"),
        F.col("themes.primary").alias("primary_theme"),
        F.col("audience.segment").alias("audience_segment"),
        F.round(F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure), 2).alias("confidence_score"),
    )
    return rows.select(key, F.col("region.detected").alias("detected_region"), (~F.col("region.is_valid")).alias("rejected_wrong_region")).join(labels, key, "left")


def with_batches(df: DataFrame, analyse: Callable[[pd.DataFrame], pd.DataFrame], schema: str, fallback: dict, partitions: int | None = None) -> DataFrame:
    """A caller's batch function over rows.  A batch that fails is cut until the rows that fail stand alone; these give the
    fallback's values and the error's text, the others what the function says of them.

    ``schema`` is of the whole result, and ends with ``enrichment_error string``.  With ``partitions`` rows are dealt into
    so many tasks first: small files come as few tasks, and a batch function costs more than a shuffle.
    """

    def tried(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame | Exception]]:
        """(place, result or error) of pieces that succeed and of single rows that fail, in order.

        Pieces are about as long as the rows between two failures so far, and one that fails is halved towards its first
        failing row: where few rows fail there are few calls, and where all do one a row.
        """

        def one(at: int, end: int) -> pd.DataFrame | Exception:
            try:
                return analyse(batch.iloc[at:end])
            except Exception as error:  # noqa: BLE001  a caller's function may fail in any way
                return error

        at, size, failed = 0, len(batch), 0
        while at < len(batch):
            end = min(len(batch), at + size)
            found = one(at, end)
            while isinstance(found, Exception) and end - at > 1:
                middle = (at + end) // 2
                found = one(at, middle)
                if isinstance(found, Exception):
                    end = middle
                else:
                    yield at, found
                    at = middle
                    found = one(at, end) if end - at == 1 else ValueError()
            yield at, found
            failed += isinstance(found, Exception)
            at = end
            size = max(1, int(0.7 * at / failed)) if failed else len(batch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alike: dict[tuple, list[pd.DataFrame]] = {}
            places, errors = [], []
            for at, found in tried(batch):
                if isinstance(found, Exception):
                    places.append(at)
                    errors.append(str(found))
                else:  # results of other types stay apart, so that none is converted
                    alike.setdefault(tuple(zip(found.columns, found.dtypes, strict=True)), []).append(found)
            for results in alike.values():
                yield pd.concat(results, ignore_index=True).assign(enrichment_error=None)
            if places:
                yield batch.iloc[places].assign(**fallback, enrichment_error=errors)

    return (df.repartition(partitions) if partitions else df).mapInPandas(run, schema)
