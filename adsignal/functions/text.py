"""Row functions on links, dates, html and model replies: columns in, columns out.

Missing values give null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_ids(link: Column) -> tuple[Column, Column]:
    """(advertiser id, creative id) of an ad's link."""
    return F.nullif(F.regexp_extract(link, "/advertiser/([^/?#]+)", 1), F.lit("")), F.nullif(F.regexp_extract(link, "/creative/([^/?#]+)", 1), F.lit(""))


def url_parameter(url: Column, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit(default).cast("string"))


def advertiser_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(AR\d+)", 1), F.lit(""))


def image_source(html: Column) -> Column:
    """The first src of the html, the html itself without one, '' for nothing."""
    found = F.regexp_extract(html, r"""src\s*=\s*["']([^"']+)["']""", 1)
    return F.when(F.coalesce(html, F.lit("")) == "", "").when(found == "", html).otherwise(found)


def format_name(code: Column) -> Column:
    return F.when(code == 1, "Text").when(code == 2, "Image").when(code == 3, "Video").otherwise(F.format_string("Unknown (%d)", code))


def format_of_creative(text: Column, image: Column, video: Column, iframe: Column | None = None) -> Column:
    """video > image > text; with an iframe flag: iframe > image > video > text."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    if iframe is None:
        return F.when(has(video), "Video").when(has(image), "Image").when(has(text), "Text").otherwise("Unknown")
    return F.when(F.coalesce(iframe, F.lit(False)), "Interactive").when(has(image), "Image").when(has(video), "Video").when(has(text), "Text").otherwise("Unknown")


def youtube_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:/vi/|[?&]v=|youtu\.be/|/embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def youtube_urls(video_id: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id), F.concat(F.lit("https://i.ytimg.com/vi/"), video_id, F.lit("/hqdefault.jpg"))


def region_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?i)^shown in (the )?", ""))


def named(code: Column, names: dict[str, str]) -> Column:
    """A code's name, or the code."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[code], code)


def date_range(text: Column) -> tuple[Column, Column]:
    """Both dates of 'Jan 2, 2024 - Feb 3, 2024'."""
    day = r"([A-Za-z]{3} \d{1,2}, \d{4})"
    at = lambda i: F.try_to_date(F.regexp_extract(text, f"{day}\\s*-\\s*{day}", i), "MMM d, yyyy")
    return at(1), at(2)


def duration_bucket(first: Column, last: Column) -> Column:
    """Whole days begun, as words; months and years are rounded half up."""
    days = F.ceil(F.abs(F.unix_timestamp(last) - F.unix_timestamp(first)) / 86400)
    half_up = lambda x: F.floor(x + 0.5)
    return F.when(days == 0, "Same day").when(days == 1, "1 day").when(days < 30, F.format_string("%d days", days)).when(days < 365, F.format_string("%d months", half_up(days / 30))).otherwise(F.format_string("%d years", half_up(days / 365)))


def dimensions(url: Column) -> tuple[Column, Column]:
    """(width, height) of a url or text: width=/height=, w=/h=, 'width: 300', 'w300-h250' or '300x250' (also with \u00d7)."""
    part = lambda p, i=1: F.nullif(F.regexp_extract(url, p, i), F.lit(""))
    pair, short = r"(\d{2,4})\s*[x\u00d7]\s*(\d{2,4})", r"\bw(\d+)[^\dh]*h(\d+)"
    width = F.coalesce(part(r"\bwidth\s*[=:]\s*(\d+)"), part(r"[?&]w=(\d+)"), part(short), part(pair))
    height = F.coalesce(part(r"\bheight\s*[=:]\s*(\d+)"), part(r"[?&]h=(\d+)"), part(short, 2), part(pair, 2))
    return width.try_cast("int"), height.try_cast("int")


#: Sizes of display ads and their names.
SIZES = {(300, 250): "Medium Rectangle", (728, 90): "Leaderboard", (160, 600): "Wide Skyscraper", (320, 50): "Mobile Banner", (300, 600): "Half Page", (970, 250): "Billboard"}


def size_bucket(html: Column) -> Column:
    """The name of the html's size, or its shape."""
    number = lambda name: F.nullif(F.regexp_extract(html, f'{name}="(\\d+)"', 1), F.lit("")).try_cast("int")
    w, h = number("width"), number("height")
    out = F.when(w.isNull() | h.isNull(), "Unknown")
    for (x, y), name in SIZES.items():
        out = out.when((w == x) & (h == y), name)
    return out.when(h > w, "Vertical").when(w > 2 * h, "Banner").otherwise("Square/Rectangle")


def display_date(text: Column) -> Column:
    """'Jan 02, 2024' of a timestamp's text, else the text."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.regexp_replace(text, "Z$", "")), "MMM dd, yyyy"), text)


def any_timestamp(text: Column) -> Column:
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(parsed, F.lit("0001-01-01 00:00:00").cast("timestamp"))


def json_in_reply(reply: Column, schema: str) -> Column:
    """The struct between a reply's first '{' and last '}', fences or not."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema)


def json_array_in_reply(reply: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), schema)


#: Examples of how lines begin that talk about an ad instead of quoting it; which ones a model writes is for the caller to say.
COMMENTS = ["the ad ", "more details", "note:"]


def without_comments(lines: Column, comments: list[str]) -> Column:
    said = lambda line: held(F.lower(line), lambda low: F.exists(F.array(*map(F.lit, comments)), lambda c: F.startswith(low, c)))
    return F.filter(lines, lambda line: (line != "") & ~said(line))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def sections(reply: Column, names: list[str], comments: list[str] = COMMENTS) -> Column:
    """map<name, text> of a reply with numbered headings ('2. Brand: ...'), the i-th name for number i.

    A heading's text begins behind its colon and goes on to the next heading; comments and empty lines are left out.
    """
    kind = "struct<n:int,rows:array<struct<n:int,line:string>>>"
    start = F.struct(F.lit(None).cast("int").alias("n"), F.array().cast("array<struct<n:int,line:string>>").alias("rows")).cast(kind)

    def parsed(line: Column) -> Column:
        number = F.when(F.substring(line, 1, 1).between("0", "9"), F.regexp_extract(line, r"^(\d+)[.)]", 1).try_cast("int"))
        return held(number, lambda n: F.struct(n.alias("n"), F.when(n.isNull(), line).otherwise(F.trim(F.regexp_extract(line, r"^\d+[.)][^:]*:(.*)$", 1))).alias("line")))

    def step(done: Column, x: Column) -> Column:
        n = F.coalesce(x["n"], done["n"])
        row = F.array(F.struct(n.alias("n"), x["line"].alias("line")))
        return F.struct(n.alias("n"), F.when(n.isNull() | (x["line"] == ""), done["rows"]).otherwise(F.concat(done["rows"], row)).alias("rows"))

    def named_texts(rows: Column) -> Column:
        text = lambda i: F.array_join(without_comments(F.transform(F.filter(rows, lambda r: r["n"] == i), lambda r: r["line"]), comments), "\n")
        return F.map_filter(F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), text(i))]), lambda _, v: v != "")

    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), lambda raw: held(F.trim(F.replace(raw, F.lit("**"), F.lit(""))), parsed))
    return held(F.aggregate(lines, start, step, lambda x: x["rows"]), named_texts)


def visible_text(reply: Column, names: list[str], comments: list[str] = COMMENTS, found: Column | None = None) -> Column:
    """What the ad itself says: the first section, or without it the whole reply, comments left out.

    ``found`` is what ``sections`` gives, where that is a column already.
    """
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r?\n"), lambda line: F.trim(line))
    return F.coalesce((sections(reply, names, comments) if found is None else found)[names[0]], F.array_join(without_comments(lines, comments), "\n"))


def merged_transcripts(parts: Column, least_share: float = 0.3) -> Column:
    """The longest transcript, then those of at least 30 % of its length that what is there does not contain."""
    ordered = F.transform(F.array_sort(F.transform(F.filter(parts, lambda p: F.coalesce(F.trim(p), F.lit("")) != ""), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda s: s["p"])
    longest = F.length(F.try_element_at(ordered, F.lit(1)))
    add = lambda done, p: F.when(done == "", p).when((F.length(p) >= least_share * longest) & ~F.contains(done, p), F.concat(done, F.lit("\n"), p)).otherwise(done)
    return F.aggregate(ordered, F.lit(""), add)


def sources_confidence(parts: Column) -> Column:
    n = F.size(F.filter(parts, lambda p: F.coalesce(F.trim(p), F.lit("")) != ""))
    return F.when(n >= 3, 0.98).when(n == 2, 0.85).when(n == 1, 0.60).otherwise(0.10)


def composed(parts: Column) -> Column:
    """Trimmed parts, each once whatever its case, joined by line feeds."""
    trimmed = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.coalesce(p, F.lit("")) != "")
    add = lambda done, p: F.when(F.exists(done, lambda d: F.lower(d) == F.lower(p)), done).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(trimmed, F.array().cast("array<string>"), add), "\n")


def slug_title(slug: Column) -> Column:
    """'a-big-shop-2' -> 'A Big Shop 2': words with a capital; null for numbers alone and for less than three letters."""
    words = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    out = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(~slug.rlike("^[0-9]+$") & (F.length(out) > 2), out)


def capitals(word: Column) -> Column:
    """A word with a capital after each apostrophe or hyphen; words of two letters stay."""
    one = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    by = lambda w, sign: F.array_join(F.transform(F.split(w, sign), one), sign)
    return F.when(F.length(word) <= 2, word).when(F.contains(word, F.lit("-")), by(word, "-")).otherwise(by(word, "'"))


def trimmed_name(name: Column, stop: list[str], most: int = 5) -> Column:
    """The words of a name before the first stop word, at most so many, with capitals; '' for none."""
    words = F.filter(F.split(F.regexp_replace(name, r"^[\s|\u2013-]+|[\s|\u2013-]+$", ""), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w'-]+", "")))
    ends = F.array_position(F.transform(bare, lambda w: F.array_contains(F.array(*map(F.lit, stop)), w)), True)
    kept = F.slice(words, F.lit(1), F.least(F.when(ends > 0, ends.cast("int") - 1).otherwise(F.size(words)), F.lit(most)))
    return F.array_join(F.transform(kept, capitals), " ")


def placed(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct(start, value)> of every match (or of a group in it), start being the match's, from 0."""
    kind = "array<struct<start:int,value:string>>"
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(done: Column, x: Column) -> Column:
        at = done["at"] + F.length(x["gap"])
        return F.struct((at + F.length(x["whole"])).alias("at"), F.concat(done["rows"], F.array(F.struct(at.alias("start"), x["value"].alias("value"))).cast(kind)).alias("rows"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("rows"))
    return F.aggregate(F.filter(found, lambda x: x["whole"].isNotNull()), start, step, lambda x: x["rows"])


def product_name(brand: Column, food: Column, category: Column, subscription: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(brand) & has(food), F.concat_ws(" - ", brand, food)).when(has(brand) & has(category), F.concat_ws(" - ", brand, category)).when(has(subscription), subscription).when(has(food), food).when(has(category), category).otherwise("Unknown")
