"""Tool-call linking: join calls and results by identifier, order calls by dependency, validate, write canonical JSON.

Only DataFrame functions are used.  A conversation's turns order its calls already; a dependency that does not point
back (to an earlier turn) moves its call behind what it depends on, and only then are rounds of joins needed, as many as
the longest chain of such dependencies.

Defined cases: a call without a result stays, with status ``unanswered``; a result without a call is returned with
status ``orphan``; of several results of one call the earliest counts, ties by content; equal call rows stay rows of
their own; a null identifier links with nothing; dependencies on unknown calls are ignored; calls in a cycle, or
behind one, have status ``cyclic`` and keep their turn's place; arguments that are null or no JSON object are the error ``json``; a call
of an unknown tool is the error ``unknown tool``; turns of a conversation that are neither calls nor results have status
``no call``; empty tables give empty results; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
#: Kinds as schema_of_variant names them.
KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "DOUBLE|DECIMAL|BIGINT|FLOAT", "array": "ARRAY", "object": "OBJECT"}


def errors(arguments: Column, schema: Column) -> Column:
    """Sorted errors of a JSON text against array<struct<key, kind>>; null schema: unknown tool.

    Each key of the object is looked up by itself, so equal keys further down and signs in keys don't matter.
    """
    fields = F.try_parse_json(arguments).try_cast("map<string,variant>")
    found = F.transform_values(fields, lambda _, value: F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])

    def wrong(field: Column) -> Column:
        kind = F.try_element_at(found, field["key"])
        fits = F.regexp(kind, F.concat(F.lit("^("), kinds[field["kind"]], F.lit(")$")))
        return F.when(kind.isNull(), F.concat(F.lit("missing "), field["key"])).when(~fits, F.concat(F.lit("kind of "), field["key"]))

    listed = F.array_sort(F.filter(F.transform(schema, wrong), lambda e: e.isNotNull()))
    return F.when(schema.isNull(), F.array(F.lit("unknown tool"))).when(fields.isNull(), F.array(F.lit("json"))).otherwise(listed)


def _ordered(calls: DataFrame) -> DataFrame:
    """calls with ``at`` (turn, hops), by which each stands behind what it depends on, and ``cyclic``."""
    places = calls.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).distinct()
    turn_of = places.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needs_turn"))
    edges = stored(edges.join(places, ["conv_id", "call_id"]).join(turn_of, ["conv_id", "needs"]), "edges")
    forward = edges.filter("needs_turn >= turn").count()
    if not forward:
        return calls.withColumn("at", F.struct(F.col("turn").alias("turn"), F.lit(0).alias("hops"))).withColumn("cyclic", F.lit(False))
    # Without a cycle a call moves for the last time in a round before its conversation's number of dependencies.
    touched = edges.join(edges.filter("needs_turn >= turn").select("conv_id").distinct(), "conv_id", "left_semi")
    most = touched.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    state = places.join(touched.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "call_id", F.struct(F.col("turn").alias("turn"), F.lit(0).alias("hops")).alias("at"), F.lit(-1).alias("moved"))
    for round_ in range(2 * most + 2):
        before = state.select("conv_id", F.col("call_id").alias("needs"), F.struct(F.col("at.turn").alias("turn"), (F.col("at.hops") + 1).alias("hops")).alias("behind"))
        latest = touched.join(before, ["conv_id", "needs"]).groupBy("conv_id", "call_id").agg(F.max("behind").alias("behind"))
        joined = state.join(latest, ["conv_id", "call_id"], "left")
        moves = F.coalesce(F.col("behind") > F.col("at"), F.lit(False))
        state = stored(joined.select("conv_id", "call_id", F.greatest("at", F.coalesce("behind", "at")).alias("at"), F.when(moves, F.lit(round_)).otherwise(F.col("moved")).alias("moved")), "order")
        if not state.filter(F.col("moved") == round_).head(1):
            break
    still = state.select("conv_id", "call_id", "at", (F.col("moved") > most).alias("cyclic"))
    own = F.struct(F.col("turn").alias("turn"), F.lit(0).alias("hops"))
    out = calls.join(still, ["conv_id", "call_id"], "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return out.withColumn("at", F.when(F.col("cyclic") | F.col("at").isNull(), own).otherwise(F.greatest("at", own)))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per orphan result: conv_id, turn, place, call_id, name, status, errors, message.

    schemas: name, fields array<struct<key, kind>>, one row a tool.  ``place`` orders a conversation: (turn, hops).
    """
    fields = schemas.groupBy("name").agg(F.first("fields").alias("fields"))
    answer = results.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    known = calls.filter("call_id IS NOT NULL").select("conv_id", "call_id").distinct()
    orphans = results.join(known, ["conv_id", "call_id"], "left_anti")
    rows = _ordered(calls).join(answer, ["conv_id", "call_id"], "left").join(fields, "name", "left")
    found = errors(F.col("arguments"), F.col("fields"))
    status = F.when(F.col("cyclic"), "cyclic").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    message = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("answer.content").alias("result")))
    linked = rows.select("conv_id", "turn", F.format_string("%019d.%06d", "at.turn", "at.hops").alias("place"), "call_id", "name", status.alias("status"), F.array_join(found, ", ").alias("errors"), message.alias("message"))
    lost = orphans.select("conv_id", "turn", F.format_string("%019d.%06d", "turn", F.lit(0)).alias("place"), "call_id", F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("status"), F.lit("").alias("errors"), F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("message"))
    return linked.unionByName(lost)


def from_conversations(rows: DataFrame, turns_depend: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other turns of conversations.

    A user or system turn is a call.  If its text is a JSON object with a ``name``, that is the tool, and ``id``,
    ``arguments`` and ``depends_on`` (a list) are read from it.  Otherwise a user turn calls ``reply`` with its text as
    prompt and a system turn ``configure``; plain text names no dependency, so these keep their turn's place, but with
    ``turns_depend``: then a plain user turn depends on the turn two before it, and a plain system turn takes effect
    behind the user turn right after it.  An assistant or tool turn is a result: of the call that its text names, if
    that is a JSON object with an ``id`` (content is then its ``result``), else of the turn before it.  Turns of any
    other role, or of none, come third (conv_id, turn, role, text).
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    known = rows.select("conv_id", "turn", "role", "text", F.try_parse_json("text").try_cast("map<string,variant>").alias("own"))
    read = lambda key, kind: F.try_element_at("own", F.lit(key)).try_cast(kind)
    asked = known.filter("role IN ('user', 'system')").withColumn("named", F.coalesce(read("name", "string").isNotNull(), F.lit(False)))
    is_user, explicit = F.col("role") == "user", F.col("named")
    needs = F.array().cast("array<string>")
    if turns_depend:
        before_user = rows.filter("role = 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("before_user")).distinct()
        asked = asked.join(before_user, ["conv_id", "turn"], "left")
        needs = F.when(is_user, F.array(name(F.col("turn") - 2))).when(F.col("before_user"), F.array(name(F.col("turn") + 1))).otherwise(needs)
    plain = F.when(is_user, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).otherwise(F.to_json(F.struct("text")))
    calls = asked.select(
        "conv_id",
        "turn",
        F.when(explicit, read("id", "string")).otherwise(name(F.col("turn"))).alias("call_id"),
        F.when(explicit, read("name", "string")).when(is_user, "reply").otherwise("configure").alias("name"),
        F.when(explicit, F.to_json(F.try_element_at("own", F.lit("arguments")))).otherwise(plain).alias("arguments"),
        F.when(explicit, F.coalesce(read("depends_on", "array<string>"), F.array().cast("array<string>"))).otherwise(needs).alias("depends_on"),
    )
    answers = known.filter("role IN ('assistant', 'tool')").withColumn("named", F.coalesce(read("id", "string").isNotNull(), F.lit(False)))
    result = F.try_element_at("own", F.lit("result"))
    content = F.when(explicit, F.coalesce(result.try_cast("string"), F.to_json(result))).otherwise(F.col("text"))
    results = answers.select("conv_id", "turn", F.when(explicit, read("id", "string")).otherwise(name(F.col("turn") - 1)).alias("call_id"), content.alias("content"))
    others = known.filter("role IS NULL OR role NOT IN ('user', 'system', 'assistant', 'tool')").select("conv_id", "turn", "role", "text")
    return calls, results, others


def link_conversations(rows: DataFrame, schemas: DataFrame, turns_depend: bool = False) -> DataFrame:
    """``link`` for conversations, with one more row for every turn that is neither a call nor a result (``no call``)."""
    calls, results, others = from_conversations(rows, turns_depend)
    none = F.lit(None).cast("string")
    rest = others.select("conv_id", "turn", F.format_string("%019d.%06d", "turn", F.lit(0)).alias("place"), none.alias("call_id"), none.alias("name"), F.lit("no call").alias("status"), F.lit("").alias("errors"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("message"))
    return link(calls, results, schemas).unionByName(rest)
