"""Nodes whose other properties are one VARIANT column, props: keys and kinds of values differ from node to node.

A null is an absent property. A property is plain if it is a string, a number or a boolean; vectors, lists, objects and times
aren't, and a property named embedding never is. Searches and contexts see plain properties only.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN = r"^(STRING|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|BOOLEAN|DECIMAL\(.*)$"


def with_props(nodes: DataFrame, *columns: str) -> DataFrame:
    """Nodes with these columns as one column props, in which nulls are absent."""
    return nodes.withColumn("_props", F.to_variant_object(F.struct(*[F.col(c) for c in columns]))).drop(*columns).withColumnRenamed("_props", "props")


def load_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, label, props) of the star schema's tables: of each row all its columns."""
    own = {"part": ("Part", "p_partkey"), "supplier": ("Supplier", "s_suppkey"), "nation": ("Nation", "n_nationkey"), "region": ("Region", "r_regionkey"), "customer": ("Customer", "c_custkey"), "documents": ("Document", "doc_id"), "embeddings": ("EntityCanonical", "vec_id"), "orders": ("Order", "o_orderkey")}
    out = None
    for name, (label, key) in own.items():
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        node_id = F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))
        one = with_props(df.withColumns({"_id": node_id, "_label": F.lit(label)}), *df.columns).select(F.col("_id").alias("node_id"), F.col("_label").alias("label"), "props")
        out = one if out is None else out.unionByName(one)
    return out


def properties(nodes: DataFrame, plain: bool = True) -> DataFrame:
    """(columns of nodes but props, key, kind, value) with a row for each property that isn't null; of plain ones unless all are
    asked for. kind is the name of the value's type, without a decimal's digits; value is VARIANT."""
    each = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("props").outer())).select(*[c for c in nodes.columns if c != "props"], "key", F.schema_of_variant("value").alias("_kind"), "value")
    kept = each.filter("_kind <> 'VOID'")
    if plain:
        kept = kept.filter(F.col("_kind").rlike(PLAIN) & (F.col("key") != "embedding"))
    return kept.withColumn("kind", F.regexp_replace("_kind", r"\(.*\)$", "")).drop("_kind")


def typed(key: str, kind: str) -> Column:
    """A property as a value of a type; null where it is absent or of another type."""
    return F.try_variant_get("props", f"$['{key}']", kind)


def plain_json(nodes: DataFrame) -> DataFrame:
    """(columns of nodes but props, json): an object of the plain properties, by key."""
    own = [c for c in nodes.columns if c != "props"]
    pair = F.struct(F.col("key"), F.to_json("value").alias("json"))
    rows = properties(nodes).groupBy(*own).agg(F.array_sort(F.collect_list(pair)).alias("l"))
    name = lambda x: F.to_json(F.struct(x["key"].alias("k")))
    text = F.transform("l", lambda x: F.concat(F.substr(name(x), F.lit(6), F.length(name(x)) - 6), F.lit(":"), x["json"]))
    return rows.select(*own, F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("json"))


def holding(nodes: DataFrame, needle: str) -> DataFrame:
    """(columns of nodes but props, key) of the plain properties whose value, as a string, contains the needle, whatever the case."""
    return properties(nodes).filter(F.contains(F.lower(F.expr("cast(value as string)")), F.lit(needle.lower()))).drop("value", "kind")


def schemas(nodes: DataFrame) -> DataFrame:
    """(label, schema): what the props of each label's nodes have in common."""
    return nodes.groupBy("label").agg(F.schema_of_variant_agg("props").alias("schema"))
