"""Tool-call linking with DataFrame functions only.

Calls and results are joined by identifier, ordered topologically by the calls they
depend on, their arguments validated against the tools' schemas, and each call is
serialised as canonical JSON (keys sorted at every level, no blanks).

Levels are longest paths in the dependency graph, by doubling: each round replaces a step
to a call by the steps that call takes itself, so a chain of n calls takes log2(n) rounds.
What is unresolved after log2(calls of the largest conversation) + 2 rounds hangs on a
cycle and gets no level.

Defined results: rows without a conversation or call id are left out; of repeated calls or
results with one id the one of the least position counts; a call without a result stays
(linked false), a result without a call stays with a null name; null or malformed
arguments are an error; dependencies on unknown calls are an error and otherwise ignored;
a call of an unknown tool is an error; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

KEYS = ["conv_id", "call_id"]
#: Schemas are broadcast up to so many tools, and joined plainly beyond.
BROADCAST_TOOLS = 10_000


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls with columns conv_id, call_id, depends_on."""
    wanted = calls.select(*KEYS, F.explode(F.array_distinct("depends_on")).alias("on"))
    known = calls.select("conv_id", F.col("call_id").alias("on"))
    steps = settle(wanted.join(known, ["conv_id", "on"]).select(*KEYS, "on", F.lit(1).alias("steps")), "steps")
    largest = calls.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(largest + 1)) + 2):
        onward = steps.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("next"), F.col("steps").alias("further"))
        longer = steps.join(onward, ["conv_id", "on"], "left")
        if longer.where("next is not null").isEmpty():
            break
        moved = longer.select(*KEYS, F.coalesce("next", "on").alias("on"), (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps"))
        steps = settle(moved.groupBy(*KEYS, "on").agg(F.max("steps").alias("steps")), "steps")
    roots = steps.join(steps.select("conv_id", F.col("call_id").alias("on")).distinct().withColumn("onward", F.lit(True)), ["conv_id", "on"], "left")
    found = roots.groupBy(*KEYS).agg(F.when(F.max(F.coalesce("onward", F.lit(False))), F.lit(None)).otherwise(F.max("steps")).alias("level"), F.lit(True).alias("deep"))
    return calls.select(*KEYS).join(found, KEYS, "left").select(*KEYS, F.when(F.col("deep"), F.col("level")).otherwise(0).alias("level"))


def _quoted(text: Column) -> Column:
    in_list = F.to_json(F.array(text))
    return F.substr(in_list, F.lit(2), F.length(in_list) - 2)


def _object(entries: list[tuple[str, Column]]) -> Column:
    """A JSON object of already serialised values, by key."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(entries)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls: conv_id, call_id, position, name, arguments (JSON), depends_on (ids);
    results: conv_id, call_id, position, content; schemas: name, field, type (bigint,
    double, boolean or string), required. A row for each identifier."""
    here = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = lambda df, *cols: df.where(here).groupBy(*KEYS).agg(F.min_by(F.struct("position", *cols), F.struct("position", *cols)).alias("x")).select(*KEYS, "x.*")
    calls = settle(first(calls, "name", "arguments", "depends_on"), "calls")
    given = first(results, "content").select(*KEYS, F.col("position").alias("result_position"), F.col("content").alias("result"), F.lit(True).alias("linked"))
    tools = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))
    if tools.count() <= BROADCAST_TOOLS:
        tools = F.broadcast(tools)
    known = calls.select("conv_id", F.col("call_id").alias("on"))
    asked = calls.select(*KEYS, F.explode("depends_on").alias("on"))
    lost = asked.join(known, ["conv_id", "on"], "left_anti").groupBy(*KEYS).agg(F.count("*").alias("n_lost"))
    rows = calls.join(tools, "name", "left").join(levels(calls), KEYS, "left").join(lost, KEYS, "left").join(given, KEYS, "full_outer")

    parsed = rows.withColumn("args", F.from_json("arguments", "map<string,variant>"))
    kind = lambda v: F.lower(F.schema_of_variant(v))
    fits = lambda f: (kind(F.col("args")[f["field"]]) == f["type"]) | ((f["type"] == "double") & (kind(F.col("args")[f["field"]]).startswith("decimal") | (kind(F.col("args")[f["field"]]) == "bigint")))
    has = lambda f: F.array_contains(F.map_keys("args"), f["field"])
    name_of = lambda text: lambda f: F.concat(F.lit(text), f["field"])
    told = F.concat(
        F.transform(F.filter("fields", lambda f: f["required"] & ~has(f)), name_of("missing:")),
        F.transform(F.filter("fields", lambda f: has(f) & ~F.coalesce(fits(f), F.lit(False))), name_of("type:")),
        F.transform(F.array_sort(F.array_except(F.map_keys("args"), F.transform("fields", lambda f: f["field"]))), lambda k: F.concat(F.lit("unknown:"), k)),
    )
    none = F.array().cast("array<string>")
    errors = (
        F.when(F.col("position").isNull(), F.array(F.lit("no call")))
        .when(F.col("fields").isNull(), F.array(F.lit("unknown tool")))
        .when(F.col("args").isNull(), F.array(F.lit("arguments are no object")))
        .otherwise(told)
    )
    canonical = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys("args")), lambda k: F.concat(_quoted(k), F.lit(":"), F.to_json(F.col("args")[k]))), ","), F.lit("}"))
    return (
        parsed.withColumn("errors", F.concat(errors, F.when(F.col("n_lost") > 0, F.array(F.lit("unknown dependency"))).otherwise(none), F.when(F.col("position").isNotNull() & F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none)))
        .withColumn("arguments_json", canonical)
        .withColumn("linked", F.coalesce("linked", F.lit(False)) & F.col("position").isNotNull())
        .withColumn("valid", F.size("errors") == 0)
        .withColumn("json", _object([("id", _quoted(F.col("call_id"))), ("name", _quoted(F.col("name"))), ("arguments", F.col("arguments_json")), ("result", _quoted(F.col("result")))]))
        .select(*KEYS, "position", "name", "level", "linked", "valid", "errors", "arguments_json", "result_position", "json")
    )


#: What the query's tools take: user turns are read as calls of one of two tools.
SCHEMAS = [("answer", "long", "boolean", False), ("answer", "text_md5", "string", True), ("answer", "words", "bigint", True), ("summarise", "text_md5", "string", True), ("summarise", "words", "bigint", True)]


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls (each depends on the conversation's user turn two before it, if
    there is one), the turn after each as its result."""
    ident = lambda turn: F.concat(F.col("conv_id"), F.lit("-"), turn)
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    calls = turns.where("role = 'user'").select(
        "conv_id", ident(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), F.when(words > 30, "summarise").otherwise("answer").alias("name"),
        F.to_json(F.struct(words.alias("words"), F.md5(text).alias("text_md5"), (F.length(text) > 200).alias("long"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.md5(text).alias("content"))
    return calls, results


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    return link_tool_calls(calls, results, schemas).withColumn("errors", F.array_join("errors", ";"))


ORACLE = """
with recursive t as (select conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
c as (select *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words from t where role = 'user'),
lv as (select conv_id, turn, 0 as level from c where not exists (select 1 from c b where b.conv_id = c.conv_id and b.turn = c.turn - 2)
  union all select c.conv_id, c.turn, lv.level + 1 from lv join c on c.conv_id = lv.conv_id and c.turn = lv.turn + 2),
r as (select conv_id, turn - 1 as call_turn, turn, md5(text) as content from t where role = 'assistant'),
j as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.turn, r.call_turn) as cturn, c.turn as position, case when c.turn is null then null when words > 30 then 'summarise' else 'answer' end as name,
  c.words, c.text, r.turn as rturn, r.content from c full outer join r on c.conv_id = r.conv_id and c.turn = r.call_turn),
k as (select j.*, lv.level, exists (select 1 from c b where b.conv_id = j.conv_id and b.turn = j.cturn - 2) as has_dep,
  case when position is null then null else '{"long":' || (case when length(text) > 200 then 'true' else 'false' end) || ',"text_md5":"' || md5(text) || '","words":' || words || '}' end as aj
  from j left join lv on lv.conv_id = j.conv_id and lv.turn = j.cturn),
e as (select *, concat_ws(';', case when position is null then 'no call' end, case when name = 'summarise' then 'unknown:long' end, case when position >= 2 and not has_dep then 'unknown dependency' end) as errors from k)
select conv_id, conv_id || '-' || cturn as call_id, position, name, cast(level as integer) as level, (rturn is not null and position is not null) as linked, errors = '' as valid, errors, aj as arguments_json,
  rturn as result_position,
  '{"arguments":' || coalesce(aj, 'null') || ',"id":"' || conv_id || '-' || cturn || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce('"' || content || '"', 'null') || '}' as json
from e
"""
QUERIES = {"op10_tool_call_linking": op10_tool_call_linking}
ORACLES = {"op10_tool_call_linking": ORACLE}
