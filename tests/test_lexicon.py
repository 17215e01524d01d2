"""Large lexicons and joins by likeness against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from adsignal.functions import lexicon, similar
from adsignal.functions.contains import containing
from adsignal.operators import labels

ODD = [None, "", " ", "aaaa aaa", "BURGER burger", "İstanbul ΣΑΣ", "é😀 中文 burger", "x" * 20_000 + "burger"]


def brute_hits(texts, terms):
    out = []
    for key, text in texts:
        low = (text or "").lower()
        out += [(key, t, low.count(t), low.find(t)) for t in {t.lower() for t in terms if t} if t in low]
    return sorted(out)


@pytest.mark.parametrize("most_letters", [lexicon.MOST_LETTERS, 40])
def test_term_hits_are_brute_force(spark, most_letters):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcr ") for _ in range(draw.randrange(1, 6)))
    terms = ["aa", "a", "burger", "Burger", "urge", "中文", "😀", "", None, "nothing here", *[word() for _ in range(60)]]
    texts = [(n, "".join(word() for _ in range(draw.randrange(0, 60)))) for n in range(80)] + [(100 + n, t) for n, t in enumerate(ODD) if t is None or "İ" not in t]
    rows = spark.createDataFrame(texts, "id long, text string")
    found = lexicon.term_hits(rows.withColumn("n_", F.lit("kept")), "text", spark.createDataFrame([(t,) for t in terms], "term string"), most_letters=most_letters)
    assert found.columns == ["id", "n_", "term", "n", "first_at"]
    assert sorted((r.id, r.term, r.n, r.first_at) for r in found.collect()) == brute_hits(texts, terms)


def test_many_terms_give_the_rows_of_the_join_by_grams(spark):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abcdefghij") for _ in range(n))
    terms = spark.createDataFrame(list({(word(draw.randrange(3, 7)),) for _ in range(20_000)}), "term string")
    texts = spark.createDataFrame([(" ".join(word(8) for _ in range(40)),) for _ in range(60)], "text string").distinct()
    found = lexicon.term_hits(texts.withColumn("hay", F.col("text")), "text", terms)
    assert sorted((r.hay, r.term) for r in found.collect()) == sorted(map(tuple, containing(texts, "text", terms, "term").collect()))


def test_scores_of_a_table_and_its_best_names(spark):
    entries = spark.createDataFrame([("Pizza", "pizza", 4.0), ("Pizza", "slice", 2.0), ("Burgers", "Burger", 4.0), ("Grill", "burger", 4.0), ("None", None, 1.0), ("Pizza", "pizza", 1.0)], "name string, term string, weight double")
    rows = spark.createDataFrame([(1, "A PIZZA slice, pizza"), (2, "burger"), (3, None), (4, "salad")], "id long, text string")
    scored = sorted((r.id, r.name, r.hits, r.score) for r in lexicon.lexicon_scores(rows, ["id"], "text", entries).collect())
    assert scored == [(1, "Pizza", 2, 6.0), (2, "Burgers", 1, 4.0), (2, "Grill", 1, 4.0)]
    assert sorted(map(tuple, lexicon.best_names(rows, ["id"], "text", entries, least=4.0).collect())) == [(1, "Pizza", 2, 6.0), (2, "Burgers", 1, 4.0)]
    assert lexicon.term_hits(rows.limit(0), "text", entries).count() == 0 and lexicon.term_hits(rows, "text", entries.limit(0)).count() == 0


def altered(draw, text):
    letters = list(text)
    for _ in range(draw.randrange(0, 4)):
        at, how = draw.randrange(len(letters) + 1), draw.randrange(3)
        if how == 0 and letters:
            letters.pop(min(at, len(letters) - 1))
        elif how == 1:
            letters.insert(at, draw.choice("abcdeinorst "))
        elif letters:
            letters[min(at, len(letters) - 1)] = draw.choice("abcdeinorst")
    return "".join(letters)


@pytest.fixture(scope="module")
def strings(spark):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abcdeinorst ") for _ in range(n)).strip() or "a"
    names = sorted({word(draw.randrange(1, 22)) for _ in range(300)} | {"common part " + word(5) for _ in range(60)})
    texts = sorted({altered(draw, draw.choice(names)) for _ in range(300)} | {word(draw.randrange(1, 20)) for _ in range(60)} | {"", "common part"})
    frames = spark.createDataFrame([(t, 0) for t in texts] + [(None, 0), (texts[5], 1)], "text string, kind int"), spark.createDataFrame([(n, 0) for n in names] * 2, "name string, kind int")
    return texts, names, *frames


@pytest.mark.parametrize("most", [10**9, 3])
def test_similar_strings_are_brute_force(strings, monkeypatch, most):
    texts, names, text_rows, name_rows = strings
    monkeypatch.setattr(similar, "MOST_NAMES", most)
    ratio = lambda n, t: difflib.SequenceMatcher(None, n, t).ratio()
    for least in (0.86, 0.78):
        want = {(t, n) for t in texts for n in names if t != n and t and min(len(t), len(n)) * 2 >= least * (len(t) + len(n)) and ratio(n, t) >= least}
        assert {(r.text, r.name) for r in similar.similar(text_rows, name_rows, least).collect()} == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [10**9, 3])
def test_edits_are_brute_force(strings, monkeypatch, most):
    texts, names, text_rows, name_rows = strings
    monkeypatch.setattr(similar, "MOST_NAMES", most)
    for k in (1, 2):
        want = {(t, n, d) for t in texts for n in names if t != n and t and abs(len(t) - len(n)) <= k and (d := edits(t, n)) <= k}
        found = [tuple(r) for r in similar.within_edits(text_rows, name_rows, k).collect()]
        assert set(found) == want and len(found) == len(want)
    with pytest.raises(ValueError, match="2/3"):
        similar.similar(text_rows, name_rows, 0.5)


def test_catalogs_of_any_size_give_the_same_brands(spark, monkeypatch):
    catalog = spark.createDataFrame([("Zara", "zara", "brand", 1), ("Golden Spoon", "golden spoon", "restaurant", 2), ("Talabat", "talabat", "platform", 0), ("McDonald's", "mcdonalds", "restaurant", 2)], labels.NO_CATALOG)
    texts = ["Order from Zara online", "order from Talabat now", "Blue Palm Kitchen by Talabat", "we like Blue Palm Kitchen", "a macdonalds meal", "https://shop.example/en/golden-spoon-2", "https://shop.example/en/zara", "مطعم الشرق", "Talabat Zara Market", None, "", "nothing"]
    ads = spark.createDataFrame([(n, t, f"adv{n % 3}") for n, t in enumerate(texts * 2)], "ad_id long, ad_text string, advertiser_id string")
    hints = spark.createDataFrame([("adv1", ["ZARA"]), ("adv2", ["Unheard Of"])], "advertiser_id string, brands array<string>")
    columns = ["ad_id", "brand", "brand_confidence", "brand_type", "brand_inferred", "brand_conflict"]
    few = sorted(map(str, labels.brands_of(ads, catalog, "ad_id", hints=hints).select(*columns).collect()))
    monkeypatch.setattr(labels, "MOST_NAMES", 0)
    assert sorted(map(str, labels.brands_of(ads, catalog, "ad_id", hints=hints).select(*columns).collect())) == few


def test_labels_from_a_table_are_those_of_the_same_lists(spark):
    rows = [("theme", n, t, None, i) for i, (n, ts) in enumerate(labels.THEMES.items()) for t in ts]
    rows += [("audience", n, t, None, i) for i, (n, ts) in enumerate(labels.AUDIENCES.items()) for t in ts]
    rows += [("food", n, t, w, i) for i, (n, ts) in enumerate(labels.FOODS.items()) for t, w in ts.items()]
    rows += [("family", n, t, None, i) for i, (n, ts) in enumerate(labels.FAMILIES.items()) for t in ts]
    table = spark.createDataFrame(rows, labels.LEXICON)
    texts = ["50% off burger and fries, save, best deal", "fresh tacos, burrito for kids, new menu", "pharmacy medicine vitamin for students on campus", "makeup perfume", "shawarma شاورما", "pizza slice burger", "coffee", "nothing", "", None]
    ads = spark.createDataFrame([(n, t, "a") for n, t in enumerate(texts)], "ad_id long, ad_text string, advertiser_id string")
    kept, columns = labels.counted(ads, "ad_id", "ad_text", table)
    t, none = F.col("ad_text"), F.lit("none")
    pairs = [
        (labels.themes(t, none), labels.themes(t, none, counts=columns("theme", "hits"))),
        (labels.audience(t, none, F.lit(0)), labels.audience(t, none, F.lit(0), counts=columns("audience", "hits"))),
        (labels.food(t, none), labels.food(t, none, scored=columns("food", "score"))),
        (labels.product_type(t, F.lit(None).cast("string"), F.lit(0.0)), labels.product_type(t, F.lit(None).cast("string"), F.lit(0.0), counts=columns("family", "hits"))),
    ]
    for own, of_table in pairs:
        assert all(str(r.x) == str(r.y) for r in kept.select(own.alias("x"), of_table.alias("y")).collect())
    one = table.filter("kind = 'food'").unionByName(spark.createDataFrame([("food", "Plain", "nothing", 5.0, 9)], labels.LEXICON))
    found = {r.ad_id: (r.food_category, r.primary_theme) for r in labels.enrich(ads, lexicon=one).collect()}
    assert found[7] == ("Plain", "price") and found[1][0] == "Mexican" and found[0][0] == "Burgers"


def test_regions_from_a_table_are_those_of_the_same_lists(spark):
    rows = [(code, part, t, 100 * i + n) for i, (code, parts) in enumerate(labels.REGIONS.items()) for n, (part, t) in enumerate((p, t) for p, ts in parts.items() for t in ts)]
    table = spark.createDataFrame(rows, labels.REGION_TERMS)
    texts = ["限时优惠 快来买", "Order in Dubai, call +971 or +971", "Delivery in Doha, QAR 5, shop.qa", "dubaian QAR", "AED 10", "riyadh and Dubai, doha", "دبي", "", None, "+974 +974 aed"]
    ads = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "ad_id long, ad_text string")
    found = labels.with_region(ads, "ad_id", "ad_text", table).withColumn("own", labels.region(F.col("ad_text")))
    kept = found.collect()
    assert len(kept) == len(texts)
    for r in kept:
        assert r.region.asDict() == r.own.asDict(), r.ad_text


def _per_ad(df):
    """What an ad itself goes through, in the plan of a query over ads whose texts repeat."""
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def repeated(spark):
    catalog = spark.createDataFrame([("Golden Spoon", "golden spoon", "restaurant", 2), ("Golden Spoon", "spoon", "restaurant", 2), ("Talabat", "talabat", "platform", 0)], labels.NO_CATALOG)
    texts = ["a golden spoon", "the goldan spoon", "nothing", "", None]
    return spark.createDataFrame([(n, texts[n % 5], f"adv{n % 3}") for n in range(300)], "ad_id long, ad_text string, advertiser_id string"), catalog


def test_a_text_of_many_ads_is_scanned_once(repeated):
    """F2 of round 4: every ad's text was cut into runs of words, four times over."""
    found = labels.brand_scan(*repeated, "ad_id")
    assert "Generate" not in _per_ad(found)
    assert sorted((r.ad_id, r.alias, r.source) for r in found.collect()) == [(n, ["golden spoon", "spoon"][n % 5], "catalog") for n in range(300) if n % 5 < 2]


def test_resolved_brands_stay_with_their_ads(spark, repeated):
    """F3 of round 4: texts are looked at once, but a resolver is asked by ad and answers for an ad."""
    ads, catalog = repeated
    said = lambda asked: asked.filter("ad_id % 2 = 0").select("ad_id", F.concat(F.lit("Shop "), F.col("ad_id") % 4).alias("brand"), F.lit(0.8).alias("confidence"))
    found = labels.brands_of(ads, catalog, "ad_id", resolve=said)
    assert "Generate" not in _per_ad(found) and "regexp" not in _per_ad(found)
    assert {r.ad_id: r.brand for r in found.collect()} == {n: "Golden Spoon" if n % 5 < 2 else f"Shop {n % 4}" if n % 2 == 0 else None for n in range(300)}


def test_ads_of_one_text_and_advertiser_are_labelled_once(spark, repeated):
    """F7 of round 4: the whole chain ran for every ad."""
    ads, catalog = repeated
    hints = spark.createDataFrame([("adv1", ["Zara"])], "advertiser_id string, brands array<string>")
    found = labels.enrich(ads, catalog=catalog, hints=hints)
    assert "Generate" not in _per_ad(found) and "regexp" not in _per_ad(found)
    # A hint is of the advertiser's ads alone, whatever text they share with others.
    assert {r.ad_id: r.brand for r in found.collect()} == {n: "Zara" if n % 3 == 1 else "Golden Spoon" if n % 5 < 2 else None for n in range(300)}
