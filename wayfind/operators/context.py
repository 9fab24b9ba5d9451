"""Rows to text: numbered lines, contexts, prompts."""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.functions import text as X
from wayfind.sources.store import sized

#: What stands for an empty result, and the marks of cut contexts.
NOTHING = "No results found for '{}'."
NOTHING_ON_PATHS = "No multi-hop results found for '{}'."
NOTHING_FROM_QUERY = "No results returned from query."
NO_ENTITY = "No specific entity detected. Please specify an entity or provide a custom query."
NO_ENTITY_PLAIN = "No specific entity found. Please provide more context."
NO_CHAT_MATCH = "No relevant entities found."
CUT = "\n... (context truncated)"
CUT_PLAIN = "\n... (truncated for length)"


def node_text(name: Column, text: Column, relevance: Column) -> Column:
    """A node's line behind its number."""
    return F.concat(F.lit(". ["), name, F.lit("] "), X.stars(relevance), F.lit(" "), X.clipped(text, 300))


def edge_text(kind: Column, name: Column, text: Column) -> Column:
    return F.concat(F.lit("   → "), kind, F.lit(": ["), name, F.lit("] "), X.clipped(text, 200))


def lines(rows: DataFrame, order: list, keys: list[str], plain: bool = False) -> DataFrame:
    """(keys, i, node_line, edge_line) of search rows: numbered first, so rows without a text use a number up."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)
    text, target = X.shown(), X.shown("target_")
    name, target_name = X.label(), X.label("target_labels")
    i = F.col("i").cast("string")
    if plain:
        node = F.concat(i, F.lit(". "), name, F.lit(": "), X.clipped(text, 200))
        edge = F.concat(F.lit("   → "), F.col("type"), F.lit(": "), target_name, F.lit(" - "), X.clipped(target, 150))
    else:
        node = F.concat(i, node_text(name, text, F.col("relevance")))
        edge = edge_text(F.col("type"), target_name, target)
    numbered = rows.withColumn("i", F.row_number().over(w))
    return numbered.select(*keys, "i", F.when(text != "", node).alias("node_line"), F.when(F.col("edge_id").isNotNull() & (target != ""), edge).alias("edge_line"))


def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, context): the lines of each key, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("i", F.concat_ws("\n", "node_line", "edge_line").alias("s"))))
    kept = F.filter(F.transform(ordered, lambda x: x["s"]), lambda s: s != "")
    agg = (rows.groupBy(*keys) if keys else rows.groupBy()).agg(ordered.alias("o"), F.array_join(kept, "\n").alias("context"))
    return agg.filter(F.size("o") > 0).select(*keys, "context")


def or_else(context: DataFrame, message: str) -> DataFrame:
    """The context, or the message where there is none."""
    one = context.sparkSession.createDataFrame([(message,)], "message string")
    return one.join(context, F.lit(True), "left").select(F.coalesce("context", "message").alias("context"))


def path_lines(paths: DataFrame, nodes: DataFrame, display: int = 10, keys: tuple = ()) -> DataFrame:
    """(keys, i, node_line, edge_line) of the first ``display`` paths of each key; both ends must have a text. The
    paths' ids are stored first and go to the nodes, once for both ends."""
    from wayfind.operators.paths import ORDER

    few = paths if keys else paths.orderBy(*ORDER).limit(display)
    i = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*ORDER))
    ends = sized(few.withColumn("i", i).filter(F.col("i") <= display), "paths")
    ids = ends.select(F.col("start_id").alias("node_id")).union(ends.select("end_id")).distinct()
    own = sized(nodes.join(ids, "node_id").select("node_id", X.label().alias("label"), F.left(X.shown(), F.lit(150)).alias("text")), "ends")
    for side in ("start", "end"):
        ends = ends.join(own.toDF(f"{side}_id", f"{side}_label", f"{side}_text"), f"{side}_id")
    chain = F.when(F.col("types") == "", F.lit("connected to")).otherwise(F.col("types"))
    line = F.concat(F.col("i").cast("string"), F.lit(". ["), F.col("start_label"), F.lit("] "), F.col("start_text"), F.lit(" --"), chain, F.lit("--> ["), F.col("end_label"), F.lit("] "), F.col("end_text"))
    return ends.select(*keys, "i", F.when((F.col("start_text") != "") & (F.col("end_text") != ""), line).alias("node_line"), F.lit(None).cast("string").alias("edge_line"))


def plain_values(field: T.StructField) -> Column | None:
    """A column for JSON: structs and maps keep strings, numbers and booleans; vectors go."""
    simple = (T.StringType, T.NumericType, T.BooleanType)
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if field.name == "embedding":
        return None
    if isinstance(kind, T.StructType):
        kept = [f.name for f in kind if f.name != "embedding" and isinstance(f.dataType, simple)]
        return F.when(c.isNotNull(), F.struct(*[c[k].alias(k) for k in kept])).alias(field.name) if kept else None
    if isinstance(kind, T.MapType):
        return F.map_filter(c, lambda k, v: k.cast("string") != "embedding").alias(field.name) if isinstance(kind.valueType, simple) else None
    return c


def as_json(rows: DataFrame) -> Column:
    """Compact JSON of a row; a null is an absent property and left out."""
    return F.to_json(F.struct(*[c for c in map(plain_values, rows.schema) if c is not None]))


def written(c: Column, kind: T.DataType, level: int) -> Column:
    """JSON of a value with a line for each member, two spaces in for each level; null members of structs are absent."""
    pad, end = "\n" + "  " * (level + 1), "\n" + "  " * level

    def around(parts: Column, left: str, right: str) -> Column:
        return F.when(F.size(parts) == 0, left + right).otherwise(F.concat(F.lit(left + pad), F.array_join(parts, "," + pad), F.lit(end + right)))

    if isinstance(kind, T.StructType):
        own = [F.when(c[f.name].isNotNull(), F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), written(c[f.name], f.dataType, level + 1))) for f in kind]
        return around(F.array_compact(F.array(*own)) if own else F.array().cast("array<string>"), "{", "}")
    if isinstance(kind, T.MapType):
        name = lambda e: F.to_json(F.struct(e["key"].cast("string").alias("k")))
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(F.substr(name(e), F.lit(6), F.length(name(e)) - 6), F.lit(": "), F.coalesce(written(e["value"], kind.valueType, level + 1), F.lit("null"))))
        return F.when(c.isNotNull(), around(pairs, "{", "}"))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNotNull(), around(F.transform(c, lambda x: F.coalesce(written(x, kind.elementType, level + 1), F.lit("null"))), "[", "]"))
    text = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6))


def as_spread_json(rows: DataFrame) -> Column:
    """JSON of a row, with lines and indents at all levels."""
    plain = F.struct(*[c for c in map(plain_values, rows.schema) if c is not None])
    kind = rows.select(plain.alias("r")).schema["r"].dataType
    return written(plain, kind, 0)


def records(rows: DataFrame, most: int = 15, spread: bool = False) -> DataFrame:
    """(i, node_line, edge_line) of a query's first ``most`` rows, in the query's own order: numbered JSON, compact or ``spread``
    over lines."""
    few = rows.limit(most).select((as_spread_json if spread else as_json)(rows).alias("s"), F.monotonically_increasing_id().alias("n"))
    numbered = few.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n")))
    return numbered.select("i", F.concat(F.col("i").cast("string"), F.lit(". "), F.col("s")).alias("node_line"), F.lit(None).cast("string").alias("edge_line"))


def spread_out(rows: DataFrame) -> Column:
    """JSON of a row with a line for each property, two spaces in; nulls are absent."""
    fields = {f.name: c for f in rows.schema if (c := plain_values(f)) is not None}
    value = lambda c: F.to_json(F.struct(c.alias("v")))
    pairs = [F.when(c.isNotNull(), F.concat(F.lit(f"  {json.dumps(k, ensure_ascii=False)}: "), F.substr(value(c), F.lit(6), F.length(value(c)) - 6))) for k, c in fields.items()]
    body = F.concat_ws(",\n", *pairs)
    return F.when(body == "", F.lit("{}")).otherwise(F.concat(F.lit("{\n"), body, F.lit("\n}")))


def dumped(nodes: DataFrame) -> DataFrame:
    """(i, node_line, edge_line) of a few nodes by node_id: JSON of all their properties but vectors."""
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node_id"))
    return nodes.select(i.alias("i"), spread_out(nodes.drop("node_id", "labels")).alias("node_line"), F.lit(None).cast("string").alias("edge_line"))


def capped(context: Column, most: int = 4500, mark: str = CUT) -> Column:
    return X.clipped(context, most, mark)


def prompt(question: Column, context: Column, most: int = 4500, mark: str = CUT) -> Column:
    return F.concat(F.lit("Answer from the context alone.\n\nContext:\n"), capped(context, most, mark), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def chat_prompt(conversation: Column, context: Column) -> Column:
    """Prompt of a chat: turns as an array of (patient, doctor), the last without a reply, and a context."""
    said = lambda c: F.concat(F.lit("Patient: "), F.coalesce(c["patient"], F.lit("")), F.coalesce(F.concat(F.lit("\nDoctor: "), c["doctor"]), F.lit("")))
    turns = F.array_join(F.transform(conversation, said), "\n")
    return F.concat(F.lit("Reply to the patient: ask what is still open, or say what is likely and what to do.\n\nConversation:\n"), turns, F.lit("\n\nContext:\n"), context, F.lit("\n\nReply:"))
