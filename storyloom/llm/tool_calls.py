"""Tool-call linking for chat formatting, by DataFrame functions only.

Plan: the earliest call and the earliest result of each (conversation, call id) are found by
partial aggregation, so that both sides of the shuffled hash join have unique keys. Further rows of an
identifier are told by row numbers, not by the identifier, and returned one by one beside the
join, so an identifier that repeats without end makes no pairs and no large group. Calls are ordered
topologically by levels: a call's level is one more than the highest level of the calls it
depends on. Chains of calls with one dependency each are followed by pointer doubling, so a long
conversation takes few rounds; the other calls are placed level by level. Every round is an
equality join whose result is written to the shared folder, and a round's tables go when the next
has been written. A call's place in its conversation's topological order comes from a sort of all
rows over ranges, not one of a conversation, so a conversation of any length is sorted by many tasks. No
conversation is ever collected. Arguments are parsed to VARIANT, validated against the schemas by
expressions built from these, and serialised as JSON with sorted keys and no spaces.

Defined results: a call without an id is not linked and not returned; a null conversation is a
conversation of its own. The earliest call of an identifier has its earliest result. Further calls
have a row each, with the error ``duplicate id``, a level by their own dependencies, and no
result; further results have a row each, ``duplicate result``. Dependencies mean the earliest call. Calls that depend on themselves through others have a null level and
the error ``cycle`` and no place; unknown dependencies give ``unknown dependency`` and don't delay the
call. Calls of a level are in the order of their turns and ids.
Arguments that aren't a JSON object give ``not an object``, and those that don't parse stand in the
record as ``arguments_text``; a tool without a schema gives ``unknown tool``. Results without a call are returned as orphans. Only the named columns are
read, and empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.shared import discard, materialize

#: JSON type names of a schema, as schema_of_variant tells them.
KINDS = {
    "string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>",
    "number": "BIGINT|DOUBLE|DECIMAL.*", "null": "VOID",
}


def schema_errors(arguments: Column, schema: dict) -> list[Column]:
    """An error or null for each rule of a schema: required names, types, and no other names."""
    found = []
    properties = schema.get("properties", {})
    for name, rule in properties.items():
        value = F.variant_get(arguments, f"$['{name}']", "variant")
        kind = F.schema_of_variant(value)
        if name in schema.get("required", []):
            found.append(F.when(value.isNull(), F.lit(f"missing {name}")))
        found.append(F.when(value.isNotNull() & ~kind.rlike(f"^({KINDS[rule['type']]})$"), F.lit(f"type of {name}")))
    if not schema.get("additionalProperties", True):
        names = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
        other = F.array_except(names, F.array(*(F.lit(n) for n in properties)))
        found.append(F.when(F.size(other) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(other), " "))))
    return found


def validate(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Errors of a call's arguments, in the schema's order, joined by '; ' (empty: valid)."""
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    errors = F.lit("unknown tool")
    for tool, schema in schemas.items():
        errors = F.when(name == tool, F.concat_ws("; ", *schema_errors(arguments, schema))).otherwise(errors)
    return F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool")).when(~is_object, F.lit("not an object")).otherwise(errors)


def chains(single: DataFrame, n_calls: int) -> DataFrame:
    """(conv, call_id, to, dist): where the chain from a call with one dependency leads.

    single: (conv, call_id, to). Each round doubles the distance, so a chain of n calls takes
    log2(n) rounds; what hasn't ended by then runs in a circle.
    """
    p = materialize(single.withColumn("dist", F.lit(1).cast("long")), "chains")
    last = p
    for _ in range(n_calls.bit_length() + 1):
        ahead = p.select("conv", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("dist2"))
        step = p.join(ahead, ["conv", "to"], "left").select(
            "conv", "call_id", F.coalesce("to2", "to").alias("to"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
            F.col("to2").isNotNull().alias("moved"),
        )
        step = materialize(step, "chains")
        discard(last)
        p, last = step.drop("moved"), step
        if step.where("moved").isEmpty():
            break
    return p


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, call_id, level) of calls that can be placed; edges: (conv, call_id, needs), known calls only.

    Calls with one dependency are passed over along their chains; rounds run over the others, so
    there are as many as the longest path has calls with two dependencies or more.
    """
    degree = materialize(edges.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("to")), "degrees")
    heads = chains(degree.where("n = 1").select("conv", "call_id", "to"), calls.count())
    by_need = heads.select("conv", F.col("call_id").alias("needs"), "to", "dist")
    several = edges.join(degree.where("n > 1").select("conv", "call_id"), ["conv", "call_id"], "left_semi")
    waiting = materialize(
        several.join(by_need, ["conv", "needs"], "left")
        .select("conv", "call_id", F.coalesce("to", "needs").alias("needs"), F.coalesce("dist", F.lit(0)).alias("extra"), F.lit(None).cast("long").alias("at")),
        "dependencies",
    )
    roots = calls.select("conv", "call_id").join(degree.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
    placed = newest = materialize(roots.withColumn("level", F.lit(0).cast("long")), "levels")
    while not waiting.isEmpty():
        met = newest.select("conv", F.col("call_id").alias("needs"), "level")
        seen = waiting.join(met, ["conv", "needs"], "left").withColumn("at", F.coalesce("at", F.col("level") + F.col("extra"))).drop("level")
        seen = materialize(seen, "dependencies")
        discard(waiting)
        state = seen.groupBy("conv", "call_id").agg(F.count_if(F.col("at").isNull()).alias("n"), (F.max("at") + 1).alias("level"))
        newest = materialize(state.where("n = 0").drop("n"), "levels")
        if newest.isEmpty():
            break
        placed = placed.unionAll(newest)
        waiting = materialize(seen.join(newest.select("conv", "call_id"), ["conv", "call_id"], "left_anti"), "dependencies")
        discard(seen)
    ends = placed.select("conv", F.col("call_id").alias("to"), "level")
    chained = heads.join(ends, ["conv", "to"]).select("conv", "call_id", (F.col("level") + F.col("dist")).alias("level"))
    return placed.unionAll(chained)


def again(calls: DataFrame, first: DataFrame, place: DataFrame) -> DataFrame:
    """Calls whose identifier an earlier call has (with their row numbers), with a level one over
    those of the calls they depend on, null if one of these can't be placed."""
    ids = first.select("conv", F.col("call_id").alias("needs"), F.lit(True).alias("known"))
    ids = ids.join(place.select("conv", F.col("call_id").alias("needs"), F.col("level").alias("below")), ["conv", "needs"], "left")
    needs = calls.select("row", "conv", F.explode("depends_on").alias("needs")).where(F.col("needs").isNotNull())
    state = needs.join(ids, ["conv", "needs"], "left").groupBy("row").agg(
        F.count_if(F.col("known") & F.col("below").isNull()).alias("stuck"), (F.max("below") + 1).alias("level_"),
        F.max(F.col("known").isNull()).alias("unknown"),
    )
    level = F.when(F.coalesce("stuck", F.lit(0)) == 0, F.coalesce("level_", F.lit(0).cast("long")))
    return calls.join(state, "row", "left").select(
        "conv", "call_id", "turn", "name", "arguments", F.lit(True).alias("is_call"), F.lit(True).alias("again"), level.alias("level"), "unknown"
    )


def placed_in_order(rows: DataFrame) -> DataFrame:
    """rows with ``position``: the place (from 0) of each call with a level in its conversation, by level, turn
    and id. Sorted by ranges; only the calls of a conversation in each range are counted."""
    ordered = rows.withColumn("lost", F.col("level").isNull()).repartitionByRange("conv", "lost", "level", "turn", "call_id")
    ordered = ordered.sortWithinPartitions("conv", "lost", "level", "turn", "call_id")
    ordered = materialize(ordered.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    held = ordered.where("not lost").groupBy("conv", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("conv", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    out = ordered.join(held, ["conv", "range"], "left").withColumn("position", F.when(~F.col("lost"), F.col("at") + F.col("shift")))
    return out.drop("range", "at", "shift", "lost")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Links calls (conv, call_id, turn, name, arguments JSON, depends_on array) with results
    (conv, call_id, turn, content).

    A row per call: conv, call_id, turn, level, position (in the topological order of its
    conversation), name, errors, valid, result_turn, record (canonical JSON of the call with its
    result); and a row without name per result that has no call of its own.
    """
    known = F.col("call_id").isNotNull()
    conv = F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv")
    row = F.monotonically_increasing_id().alias("row")  # written at once, so that it stays
    all_c = materialize(calls.where(known).select(conv, "call_id", "turn", "name", "arguments", "depends_on", row), "all-calls")
    all_r = materialize(results.where(known).select(conv, "call_id", "turn", "content", row), "all-results")
    c = materialize(
        all_c.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on", "row")).alias("s"))
        .select("conv", "call_id", "s.*", F.lit(True).alias("is_call")), "calls",
    )
    first_r = materialize(all_r.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content", "row")).alias("s")).select("conv", "call_id", "s.*"), "results")
    r = first_r.select("conv", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("has_result"))
    wanted = c.select("conv", "call_id", F.explode("depends_on").alias("needs")).where(F.col("needs").isNotNull()).distinct()
    ids = c.select("conv", F.col("call_id").alias("needs"), F.lit(True).alias("known"))
    wanted = materialize(wanted.join(ids, ["conv", "needs"], "left"), "dependencies")
    unknown = wanted.where(F.col("known").isNull()).groupBy("conv", "call_id").agg(F.lit(True).alias("unknown"))
    place = levels(c, wanted.where("known").select("conv", "call_id", "needs"))
    linked = c.drop("row").join(r.hint("shuffle_hash"), ["conv", "call_id"], "full").join(place, ["conv", "call_id"], "left").join(unknown, ["conv", "call_id"], "left")
    linked = linked.withColumn("is_call", F.coalesce("is_call", F.lit(False))).withColumn("again", F.lit(False)).drop("depends_on")
    more = again(all_c.join(c.select("row"), "row", "left_anti"), c, place)
    more_r = all_r.join(first_r.select("row"), "row", "left_anti").join(c.select("conv", "call_id", "is_call"), ["conv", "call_id"], "left")
    more_r = more_r.select("conv", "call_id", F.col("turn").alias("result_turn"), F.lit(False).alias("is_call"), F.col("is_call").isNotNull().alias("again"))
    parsed = more.unionByName(more_r, allowMissingColumns=True).unionByName(linked, allowMissingColumns=True).withColumn("v", F.try_parse_json("arguments"))
    errors = F.concat_ws(
        "; ", F.nullif(validate(F.col("name"), F.col("v"), schemas), F.lit("")), F.when(F.col("unknown"), F.lit("unknown dependency")),
        F.when(F.col("level").isNull(), F.lit("cycle")), F.when(F.col("again"), F.lit("duplicate id")),
    )
    record = F.to_json(
        F.struct(
            F.col("v").alias("arguments"), F.when(F.col("v").isNull(), F.col("arguments")).alias("arguments_text"),
            F.col("call_id").alias("id"), "name",
            F.when(F.col("has_result"), F.struct("content", F.col("result_turn").alias("turn"))).alias("result"), "turn",
        )
    )
    lone = F.when(F.col("again"), "duplicate result").otherwise("orphan result")
    out = parsed.select(
        "conv", "call_id", "turn", F.when(F.col("is_call"), F.col("level")).alias("level"), "name",
        F.when(F.col("is_call"), errors).otherwise(lone).alias("errors"),
        (F.col("is_call") & (errors == "")).alias("valid"), "result_turn", F.when(F.col("is_call"), record).alias("record"),
    )
    return placed_in_order(out)


#: Tools of the query on ``conversations``.
SCHEMAS = {
    "search": {
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "exact": {"type": "boolean"}},
        "required": ["query", "limit"], "additionalProperties": False,
    },
    "lookup": {"properties": {"id": {"type": "integer"}, "fields": {"type": "array"}}, "required": ["id"]},
    "rate": {"properties": {"value": {"type": "number"}, "note": {"type": "string"}}, "required": ["value"]},
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read into plain turns: every assistant turn calls a tool that its number
    of words picks, with arguments of its own words (some break the schema), and depends on the
    call two turns before; every later user turn is the result of the turn before it."""
    w = turns.select(
        F.col("conv_id").alias("conv"), "turn", "role",
        F.size(F.split(F.btrim(F.coalesce("text", F.lit(""))), " ")).alias("n"),
        F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+", 0).alias("w"), F.length(F.coalesce("text", F.lit(""))).alias("chars"),
    )
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("rate")), F.col("n") % 3 + 1)
    n = F.col("n").cast("string")
    search = F.concat(F.lit('{ "query": "'), "w", F.lit('", "limit": '), F.when(F.col("n") % 5 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n), F.lit(', "exact": true }'))
    lookup = F.concat(F.lit('{"fields":["b", "a"]'), F.when(F.col("n") % 7 != 0, F.concat(F.lit(', "id":'), n)).otherwise(""), F.lit("}"))
    rate = F.when(F.col("n") % 11 == 0, F.lit("[1, 2]")).otherwise(F.concat(F.lit('{"value": '), n, F.lit(', "note": "'), "w", F.lit('"}')))
    arguments = F.when(name == "search", search).when(name == "lookup", lookup).otherwise(rate)
    known = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    call = lambda turn: F.concat(F.lit("call-"), known(F.col("conv")), F.lit("-"), known(turn))
    calls = w.where("role = 'assistant'").select(
        "conv", call(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(call(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = w.where("role = 'user' and turn > 0").select(
        "conv", call(F.col("turn") - 1).alias("call_id"), "turn", F.concat(F.col("chars").cast("string"), F.lit(" characters")).alias("content")
    )
    return calls, results


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_conversations(table(spark, sf_dir, "conversations"))
    return link(calls, results, SCHEMAS).select(F.nullif(F.col("conv"), F.lit("")).cast("long").alias("conv_id"), "call_id", "turn", "level", "position", "name", "errors", "valid", "result_turn", "record")


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT conv_id, turn, role, len(string_split(trim(coalesce(text, '')), ' ')) AS n,
         regexp_extract(lower(coalesce(text, '')), '[a-z]+') AS w, length(coalesce(text, '')) AS chars
  FROM conversations
), c AS (
  SELECT conv_id, 'call-' || conv_id || '-' || turn AS call_id, turn, n, w,
         CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'rate' END AS name,
         CASE WHEN turn >= 2 THEN 'call-' || conv_id || '-' || (turn - 2) END AS needs
  FROM w WHERE role = 'assistant'
), r AS (
  SELECT conv_id, 'call-' || conv_id || '-' || (turn - 1) AS call_id, turn AS result_turn, chars || ' characters' AS content
  FROM w WHERE role = 'user' AND turn > 0
), k AS (SELECT c.*, d.call_id IS NOT NULL AS known FROM c LEFT JOIN c d ON d.conv_id = c.conv_id AND d.call_id = c.needs
), lv AS (
  SELECT conv_id, call_id, 0 AS level FROM k WHERE NOT known
  UNION ALL SELECT k.conv_id, k.call_id, lv.level + 1 FROM k JOIN lv ON k.conv_id = lv.conv_id AND k.needs = lv.call_id
), a AS (
  SELECT k.*, CASE name
    WHEN 'search' THEN '{ "query": "' || w || '", "limit": ' || CASE WHEN n % 5 = 0 THEN '"' || n || '"' ELSE '' || n END || ', "exact": true }'
    WHEN 'lookup' THEN '{"fields":["b", "a"]' || CASE WHEN n % 7 <> 0 THEN ', "id":' || n ELSE '' END || '}'
    ELSE CASE WHEN n % 11 = 0 THEN '[1, 2]' ELSE '{"value": ' || n || ', "note": "' || w || '"}' END END AS raw
  FROM k
), rule(name, place, property, kinds, required) AS (VALUES
  ('search', 1, 'query', ['VARCHAR'], true), ('search', 2, 'limit', ['UBIGINT', 'BIGINT'], true), ('search', 3, 'exact', ['BOOLEAN'], false),
  ('lookup', 1, 'id', ['UBIGINT', 'BIGINT'], true), ('lookup', 2, 'fields', ['ARRAY'], false),
  ('rate', 1, 'value', ['UBIGINT', 'BIGINT', 'DOUBLE'], true), ('rate', 2, 'note', ['VARCHAR'], false)
), tests AS (
  SELECT a.conv_id, a.call_id, rule.place, CASE
           WHEN json_type(raw, '$.' || property) IS NULL THEN CASE WHEN required THEN 'missing ' || property END
           WHEN NOT list_contains(kinds, json_type(raw, '$.' || property)) THEN 'type of ' || property END AS bad
  FROM a JOIN rule ON rule.name = a.name WHERE json_type(raw) = 'OBJECT'
  UNION ALL
  SELECT a.conv_id, a.call_id, 9, 'unknown ' || key FROM (SELECT *, unnest(json_keys(raw)) AS key FROM a WHERE name = 'search') a
  WHERE key NOT IN (SELECT property FROM rule WHERE name = 'search')
  UNION ALL SELECT conv_id, call_id, 0, 'not an object' FROM a WHERE json_type(raw) <> 'OBJECT'
), bad AS (SELECT conv_id, call_id, string_agg(bad, '; ' ORDER BY place) AS bad FROM tests GROUP BY conv_id, call_id
), members AS (
  SELECT conv_id, call_id, '{' || string_agg('"' || key || '":' || json(json_extract(raw, '$.' || key)), ',' ORDER BY key) || '}' AS args
  FROM (SELECT *, unnest(json_keys(raw)) AS key FROM a WHERE json_type(raw) = 'OBJECT') GROUP BY conv_id, call_id
), e AS (
  SELECT a.*, coalesce(m.args, json(raw)) AS args, lv.level, row_number() OVER (PARTITION BY a.conv_id ORDER BY lv.level, a.turn, a.call_id) - 1 AS place,
         concat_ws('; ', bad.bad, CASE WHEN needs IS NOT NULL AND NOT known THEN 'unknown dependency' END) AS errs
  FROM a LEFT JOIN bad USING (conv_id, call_id) LEFT JOIN members m USING (conv_id, call_id) LEFT JOIN lv USING (conv_id, call_id)
)
SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.call_id, r.call_id) AS call_id, e.turn AS turn, CAST(e.level AS BIGINT) AS level,
       CASE WHEN e.call_id IS NOT NULL THEN e.place END AS position, e.name AS name,
       CASE WHEN e.call_id IS NULL THEN 'orphan result' ELSE e.errs END AS errors,
       e.call_id IS NOT NULL AND e.errs = '' AS valid, r.result_turn AS result_turn,
       CASE WHEN e.call_id IS NOT NULL THEN '{"arguments":' || e.args || ',"id":"' || e.call_id || '","name":"' || e.name || '"'
         || CASE WHEN r.call_id IS NOT NULL THEN ',"result":{"content":"' || r.content || '","turn":' || r.result_turn || '}' ELSE '' END
         || ',"turn":' || e.turn || '}' END AS record
FROM e FULL JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id
"""
