"""Chat formatting: linking tool calls and results, in DataFrame functions only.

Calls and results of a conversation are hash-joined by identifier, calls are put
in topological order of the calls they depend on, their arguments are validated
against the tools' schemas, and each call is serialised as canonical JSON (keys
sorted, no white space).  No conversation is gathered into one row or task: the
order is made by rounds of joins on (conversation, call), with pointers that
double along chains, and a call's position by running sums in two steps.

calls:   conv_id long, call_id string, turn long, name string, arguments string
         (JSON), after array<string> (call ids it depends on)
results: conv_id long, call_id string, turn long, content string
schemas: {tool: {parameter: (type, required)}}, type one of string, integer,
         number, boolean, array, object

status, the first that holds: `duplicate` (a second call of an identifier; the
one of the least turn, name and arguments counts), `bad_json`, `unknown_tool`,
`bad_arguments` (missing, of another type, or not in the schema), `unknown_call`
(depends on an identifier the conversation does not have), `cycle` (on a cycle or
behind one), `no_result`, `ok`.  A result without a call comes as `orphan`.  Of
several results for a call the one of the least turn and content counts.

NULL conversations or identifiers match nothing.  NULL `after` is none.  Calls
with status duplicate, unknown_call or cycle have no level; they stand behind
the others.  Very long arguments and results are serialised whole.  Empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

Schemas = dict[str, dict[str, tuple[str, bool]]]
RANGE_TURNS = 8_192      # turns of one level that are ranked together
RANGE_LEVELS = 1_024     # levels whose counts are added up together

_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN",
          "array": "ARRAY.*", "object": "OBJECT.*"}


def _quoted(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def arguments_fit(name: Column, parsed: Column, keys: Column, schemas: Schemas) -> Column:
    """Whether parsed JSON arguments with these keys fit the tool's schema; NULL
    for an unknown tool."""
    out = F.lit(None).cast("boolean")
    for tool, parameters in schemas.items():
        tests = [F.size(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]).cast("array<string>"))) == 0,
                 F.coalesce(F.schema_of_variant(parsed), F.lit("VOID")).rlike("^OBJECT")]
        for parameter, (kind, required) in parameters.items():
            value = F.try_variant_get(parsed, _quoted(parameter), "variant")
            is_kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID")).rlike(f"^({_TYPES[kind]})$")
            tests.append(is_kind if required else (is_kind | ~F.array_contains(keys, parameter)))
        out = F.when(name == tool, reduce(lambda a, b: a & b, tests)).otherwise(out)
    return out


def _chains(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, far): the call that a chain of single
    dependencies leads back to, and how many steps away.  Pointers double each
    round; chains that lead into a cycle, or to an unknown call, have no row."""
    several = (needs.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("on")))
    d = calls.select("conv_id", "call_id").join(several, ["conv_id", "call_id"], "left")
    chained = F.coalesce(F.col("n"), F.lit(0)) == 1
    d = stage_table(d.select("conv_id", "call_id", F.when(chained, F.col("on")).otherwise(F.col("call_id")).alias("root"),
                             F.when(chained, 1).otherwise(0).cast("bigint").alias("far"), (~chained).alias("ended")), "op4-chains")
    ended = d.filter("ended").count()
    while True:
        up = d.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("up"), F.col("far").alias("more"), F.col("ended").alias("up_ended"))
        d = stage_table(d.join(up, ["conv_id", "root"], "left").select(
            "conv_id", "call_id", F.when(F.col("ended"), F.col("root")).otherwise(F.coalesce("up", "root")).alias("root"),
            F.when(F.col("ended"), F.col("far")).otherwise(F.col("far") + F.coalesce("more", F.lit(0))).alias("far"),
            (F.col("ended") | F.coalesce("up_ended", F.lit(False))).alias("ended")), "op4-chains")
        now = d.filter("ended").count()
        if now == ended:
            return d.filter("ended").select("conv_id", "call_id", "root", "far")
        ended = now


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies, else one more than the
    highest.  Calls on or behind a cycle or an unknown call are left out.

    `calls` has each (conv_id, call_id) once.  A chain of single dependencies of
    any length takes rounds of its logarithm; beyond that, rounds follow how
    deep calls of several dependencies stand behind each other."""
    need = stage_table(calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("on")), "op4-needs")
    chain = _chains(calls, need)
    count = need.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("open"))
    many = count.filter("open > 1")
    free = calls.join(count, ["conv_id", "call_id"], "left_anti").select("conv_id", F.col("call_id").alias("root"), F.lit(0).cast("bigint").alias("base"))
    # what a call of several dependencies waits for: the roots of their chains
    waits = stage_table(need.join(many, ["conv_id", "call_id"]).join(
        chain.select("conv_id", F.col("call_id").alias("on"), "root", "far"), ["conv_id", "on"], "left"), "op4-waits")
    placed = stage_table(free, "op4-level")
    while True:
        ready = (waits.join(placed, ["conv_id", "root"]).groupBy("conv_id", "call_id", "open")
                 .agg(F.count(F.lit(1)).alias("met"), F.max(F.col("base") + F.col("far") + 1).alias("base")).filter("met = open")
                 .select("conv_id", F.col("call_id").alias("root"), "base"))
        last = stage_table(ready.join(placed, ["conv_id", "root"], "left_anti"), "op4-level")
        if last.isEmpty():
            return chain.join(placed, ["conv_id", "root"]).select("conv_id", "call_id", (F.col("base") + F.col("far")).cast("int").alias("level"))
        placed = placed.unionByName(last)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, call_id, turn, name, level, position, status, json) per call, and
    per result without a call."""
    rows = calls.select(
        F.col("conv_id").cast("bigint"), F.col("call_id").cast("string"), F.col("turn").cast("bigint"), F.col("name").cast("string"),
        F.col("arguments").cast("string"), F.coalesce(F.col("after"), F.array().cast("array<string>")).alias("after"))
    same = Window.partitionBy("conv_id", "call_id").orderBy("turn", "name", "arguments")
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    # an identifier's repeats: without one, each row is a call of its own
    rows = stage_table(rows.withColumn("repeat", F.when(known, F.row_number().over(same)).otherwise(1)), "op4-calls")
    first = rows.filter(known & (F.col("repeat") == 1)).select("conv_id", "call_id", "after")
    level = call_levels(first)
    lost = (first.select("conv_id", "call_id", F.explode("after").alias("on"))
            .join(first.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_anti")
            .select("conv_id", "call_id").distinct().withColumn("lost", F.lit(True)))
    answer = (results.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
              .groupBy(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"))
              .agg(F.min(F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("content").cast("string").alias("content"))).alias("answer")))
    d = (rows.withColumn("is_call", F.lit(True)).hint("shuffle_hash").join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
         .join(level, ["conv_id", "call_id"], "left").join(lost, ["conv_id", "call_id"], "left"))
    # parsed once, then judged once: both are used several times above
    d = d.withColumns({"parsed": F.try_parse_json("arguments"),
                       "keys": F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))})
    d = d.withColumn("fits", arguments_fit(F.col("name"), F.col("parsed"), F.col("keys"), schemas))
    fits, parsed = F.col("fits"), F.col("parsed")
    status = (F.when(F.col("is_call").isNull(), "orphan").when(F.col("repeat") > 1, "duplicate").when(parsed.isNull(), "bad_json")
              .when(fits.isNull(), "unknown_tool").when(~fits, "bad_arguments").when(F.col("lost"), "unknown_call")
              .when(known & F.col("level").isNull(), "cycle").when(F.col("answer").isNull(), "no_result").otherwise("ok"))
    d = d.select("conv_id", "call_id", F.coalesce("turn", "answer.turn").alias("turn"), "name",
                 F.when(F.coalesce(F.col("repeat"), F.lit(1)) == 1, F.col("level")).alias("level"), status.alias("status"),
                 _canonical(parsed).alias("json"))
    return _positions(d)


def _canonical(parsed: Column) -> Column:
    """{"arguments":..,"id":..,"name":..,"result":..}; what is NULL is left out."""
    def text(key: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))

    def quoted(value: Column) -> Column:
        return F.to_json(F.to_variant_object(F.array(value)))

    plain = [text("arguments", F.to_json(parsed))]
    for key, value in (("id", F.col("call_id")), ("name", F.col("name")), ("result", F.col("answer.content"))):
        q = quoted(value)
        plain.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), F.substr(q, F.lit(2), F.length(q) - 2))))
    return F.concat(F.lit("{"), F.concat_ws(",", *plain), F.lit("}"))


def _positions(d: DataFrame) -> DataFrame:
    """Adds the rank of each row in its conversation, by level, turn, identifier."""
    part = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("level"), F.floor(F.coalesce("turn", F.lit(0)) / RANGE_TURNS).alias("turns"))
    d = d.withColumn("part", part)
    own = Window.partitionBy("conv_id", "part").orderBy("turn", "call_id", "status", "json")
    # what stands before a part: over ranges of levels, then within the range
    count = (d.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("levels", F.floor(F.col("part.level") / RANGE_LEVELS)))
    within = Window.partitionBy("conv_id", "levels").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("levels").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (count.groupBy("conv_id", "levels").agg(F.sum("n").alias("n"))
              .select("conv_id", "levels", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lower")))
    count = (count.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).alias("p")
             .join(ranges.alias("r"), F.col("p.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("p.levels") == F.col("r.levels")))
             .select("p.conv_id", "p.part", (F.col("p.own") + F.col("r.lower")).alias("before")))
    on = F.col("d.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("d.part") == F.col("c.part"))
    return (d.withColumn("rank", F.row_number().over(own)).alias("d").join(count.alias("c"), on)
            .select("d.conv_id", "d.call_id", "d.turn", "d.name", "d.level", (F.col("c.before") + F.col("d.rank") - 1).cast("bigint").alias("position"),
                    "d.status", "d.json"))


# Tools of the conversations below.
SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "lookup": {"key": ("string", True), "exact": ("boolean", False)},
    "translate": {"text": ("string", True), "to": ("string", True)},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns: every assistant turn calls a tool
    with arguments from its text and depends on the call two turns earlier, if
    that was one; a user turn after an assistant turn is that call's result.
    Some texts make arguments that do not fit their schema."""
    t = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n, words = F.length("text"), F.size(F.split("text", " "))
    head = F.split("text", "\n")[0]
    limit = F.when(F.pmod(words, F.lit(7)) == 0, F.concat(F.lit('"'), words.cast("string"), F.lit('"'))).otherwise(words.cast("string"))

    def text(value: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(value, r'(["\\])', r"\\$1"), "\n", r"\\n")

    kind = F.pmod(n, F.lit(3))
    arguments = (F.when(kind == 0, F.concat(F.lit('{ "query": "'), text(head), F.lit('", "limit": '), limit, F.lit("}")))
                 .when(kind == 1, F.concat(F.lit('{"key":  "'), text(F.substring_index(head, " ", 1)), F.lit('", "exact": '),
                                           (F.pmod(words, F.lit(2)) == 0).cast("string"), F.lit("}")))
                 .when(F.pmod(words, F.lit(11)) == 0, F.concat(F.lit('{"text": "'), text(F.col("text")), F.lit('"}')))
                 .otherwise(F.concat(F.lit('{"to": "en", "text": "'), text(F.col("text")), F.lit('"}'))))

    def name(turn: Column) -> Column:
        return F.concat(F.lit("call_"), turn.cast("string"))

    turns = t.filter("role = 'assistant'").select("conv_id", "turn").distinct()
    back = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.array(name(F.col("turn"))).alias("after"))
    calls = (t.filter("role = 'assistant'").join(back, ["conv_id", "turn"], "left")
             .select("conv_id", name(F.col("turn")).alias("call_id"), "turn",
                     F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("translate")), (kind + 1).cast("int")).alias("name"),
                     arguments.alias("arguments"), "after"))
    follows = turns.select("conv_id", (F.col("turn") + 1).alias("turn"))
    results = (t.filter("role = 'user'").join(follows, ["conv_id", "turn"], "left_semi")
               .select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")))
    return calls, results
