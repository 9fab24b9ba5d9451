"""Tables that are merged when they are read, all of them under one numbered log.

A table's rows lie in layers: folders that one job wrote and nothing changes any more. Rows that a later change replaces or
deletes stay where they are, and their places are listed in a folder of their own (`gone`); a reader leaves these out. So a
change writes its own rows and no others. Each layer is dealt to folders by a hash of the table's key, and a change looks for
the rows that it replaces in the folders of its own keys only; within a folder, rows lie in the key's order with a Bloom filter for each file.

A version is a small file that names the layers of all tables. It appears by one step that fails if the name is taken, so
readers see all of a change or nothing, in all tables, and a job that dies leaves folders that no version names. A change
knows the version that it has read. If others have been committed meanwhile, it looks for rows to replace in their
layers too, and goes on from their version; so two upserts hold both, and the later one has the last word on a key. What can't
be put behind them fails with Conflict: a change that has read a table in which rows have gone, one that adds keys that are there
now, and a compaction of layers that lost rows.
"""

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
FEW = 1000  # values up to which a filter names them, so that a scan skips what has none of them
SMALL = 1 << 20  # places of rows that have gone, up to which they are broadcast


class Conflict(Exception):
    """Another change has been committed that this one can't be put behind."""


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with a text, whole, unless there is one of that name. A link (local folders) or a rename that never
    replaces (others) decides between writers."""
    jvm = spark.sparkContext._jvm
    fs, final = file_system(spark, path)
    temp = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(temp, False)
    out.write(text.encode())
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(final), local(temp))
            return True
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(temp, final, options)
        return True
    except Exception:
        if not fs.exists(final):
            raise
        return False
    finally:
        fs.delete(temp, False)


def bucket_of(own: dict):
    return F.pmod(F.xxhash64(*own["by"]), F.lit(own["buckets"])).cast("int")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Log:
    """The tables in ``folder``, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        fs, p = file_system(self.spark, f"{self.folder}/log")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        """{"version", "tables": {name: {"key", "buckets", "schema", "layers": {layer: rows}, "gone": {place: rows}}}}."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "tables": {}}
            version = found[-1]
        return json.loads(read_text(self.spark, f"{self.folder}/log/{version:012d}.json"))

    def begin(self) -> "Change":
        return Change(self, self.state())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table's rows, in the latest version without a number."""
        return self.rows(self.table(self.state(version), name), name).drop("layer", "bucket", "_row")

    def table(self, state: dict, name: str) -> dict:
        if name not in state["tables"]:
            raise KeyError(f"no table {name} in version {state['version']}")
        return state["tables"][name]

    def layered(self, own: dict, name: str, layers: list[str]) -> DataFrame:
        """Rows of some layers, gone or not, with their layer, bucket and number."""
        kind = T.StructType.fromJson(own["schema"])
        whole = T.StructType([*kind.fields, T.StructField("_row", T.LongType()), T.StructField("layer", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not layers:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/layer={x}" for x in layers])

    def rows(self, own: dict, name: str) -> DataFrame:
        """A table's rows with their places."""
        df = self.layered(own, name, sorted(own["layers"]))
        if not own["gone"]:
            return df
        gone = self.spark.read.schema("layer string, _row long").parquet(*[f"{self.folder}/{name}_gone/{x}" for x in sorted(own["gone"])])
        return df.join(F.broadcast(gone) if sum(own["gone"].values()) <= SMALL else gone, ["layer", "_row"], "left_anti")

    def compact(self, name: str) -> int:
        """Write a table's rows anew as one layer. Changes that only add rows may go on meanwhile; one that replaces rows makes this
        fail with Conflict."""
        change = self.begin()
        change.rewrite(name)
        return change.commit()

    def clean(self, keep: int = 1) -> list[str]:
        """Delete folders that none of the last ``keep`` versions names; gives them. For times without writers."""
        wanted: set[str] = set()
        for v in self.versions()[-keep:]:
            for name, own in self.state(v)["tables"].items():
                wanted |= {f"{name}/layer={x}" for x in own["layers"]} | {f"{name}_gone/{x}" for x in own["gone"]}
        fs, root = file_system(self.spark, self.folder)
        out = []
        for table in [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() != "log"]:
            for own in [s.getPath() for s in fs.listStatus(table)]:
                place = f"{table.getName()}/{own.getName()}"
                if place not in wanted:
                    fs.delete(own, True)
                    out.append(place)
        return sorted(out)


@dataclass
class Part:
    """What a change does to one table."""

    new: dict | None = None
    layers: dict[str, int] = field(default_factory=dict)
    gone: dict[str, int] = field(default_factory=dict)
    replaced: list[DataFrame] = field(default_factory=list)  # keys whose rows go
    inserted: list[DataFrame] = field(default_factory=list)  # keys that nobody else may have
    drops: list[str] | None = None  # layers that a rewrite has made needless


class Change:
    """A change to some tables, from one version to a later one. Rows are written at once; commit() makes them seen."""

    def __init__(self, log: Log, state: dict):
        self.log, self.spark, self.base = log, log.spark, state
        self.parts: dict[str, Part] = {}
        self.read_tables: set[str] = set()

    def read(self, name: str) -> DataFrame:
        """A table as this change sees it. If rows of it go before the commit, the commit fails."""
        self.read_tables.add(name)
        return self.log.rows(self.log.table(self.base, name), name).drop("layer", "bucket", "_row")

    def part(self, name: str) -> Part:
        return self.parts.setdefault(name, Part())

    def spec(self, name: str, state: dict | None = None) -> dict:
        part = self.parts.get(name)
        return part.new if part and part.new else self.log.table(state or self.base, name)

    def write(self, name: str, df: DataFrame) -> tuple[str, int]:
        """Write rows as a layer; gives its name and the number of rows."""
        own = self.spec(name)
        layer = f"L{uuid.uuid4().hex}"
        key = own["key"]
        names = [f["name"] for f in own["schema"]["fields"]]
        rows = df.select(*names).withColumn("bucket", bucket_of(own))
        # Large buckets are split and small ones put together at run time; ranges would have to sample, and so make the rows twice.
        dealt = rows.hint("rebalance", "bucket").sortWithinPartitions(*own["split"], "bucket", *key).withColumn("_row", F.monotonically_increasing_id())
        writer = dealt.write.partitionBy(*own["split"], "bucket")
        for k in own["by"]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        path = f"{self.log.folder}/{name}/layer={layer}"
        writer.parquet(path)
        return layer, self.spark.read.schema("_row long").parquet(path).count()

    def create(self, name: str, df: DataFrame, key: list[str], buckets: int = BUCKETS, by: list[str] | None = None, split: list[str] | None = None) -> str:
        """A new table of rows whose ``key`` is unique, dealt by the columns ``by`` of the key (all without it); gives the
        layer, as all that adds rows does. The columns ``split``, of few values, are folders: a filter on them reads no other."""
        if name in self.base["tables"] or name in self.parts:
            raise ValueError(f"there is a table {name}")
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        part = self.part(name)
        part.new = {"key": key, "by": by or key, "split": split or [], "buckets": buckets, "schema": json.loads(schema.json()), "layers": {}, "gone": {}}
        layer, n = self.write(name, df)
        part.layers[layer] = n
        return layer

    def keys(self, name: str, df: DataFrame) -> DataFrame:
        """The different keys of some rows, with their buckets."""
        own = self.spec(name)
        return df.select(*own["key"]).distinct().withColumn("bucket", bucket_of(own))

    def found(self, name: str, keys: DataFrame, own: dict) -> DataFrame:
        """A table's rows with these keys. Only the keys' buckets are read, of which a table has few."""
        touched = sorted(r.bucket for r in keys.select("bucket").distinct().collect())
        return self.log.rows(own, name).filter(F.col("bucket").isin(touched)).join(keys.select(*own["key"]), own["key"], "left_semi")

    def having(self, name: str, df: DataFrame) -> DataFrame:
        """A table's rows, with their places, whose columns that it is dealt by are as in some rows. Only these rows' buckets are
        read."""
        own = self.log.table(self.base, name)
        wanted = df.select(*own["by"]).distinct()
        touched = sorted(r.bucket for r in wanted.select(bucket_of(own).alias("bucket")).distinct().collect())
        rows = self.log.rows(own, name).filter(F.col("bucket").isin(touched))
        few = wanted.limit(FEW + 1).collect()
        if len(few) > FEW:
            return rows.join(wanted, own["by"], "left_semi")
        for c in own["by"]:
            rows = rows.filter(F.col(c).isin(sorted({r[c] for r in few if r[c] is not None})))
        return rows if len(own["by"]) == 1 else rows.join(self.spark.createDataFrame(few, wanted.schema), own["by"], "left_semi")

    def lookup(self, name: str, df: DataFrame) -> DataFrame:
        """A table's rows, as this change sees it, with the keys of some rows."""
        return self.found(name, self.keys(name, df), self.log.table(self.base, name)).drop("layer", "bucket", "_row")

    def add(self, name: str, df: DataFrame) -> str:
        """Rows with keys that nobody else can have."""
        layer, n = self.write(name, df)
        self.part(name).layers[layer] = n
        return layer

    def append(self, name: str, df: DataFrame) -> str:
        """Rows whose keys the table doesn't have. If another change has added one of them before the commit, that fails."""
        layer = self.add(name, df)
        self.part(name).inserted.append(self.keys(name, self.layer(name, layer)))
        return layer

    def upsert(self, name: str, df: DataFrame) -> str:
        """Rows, each with a key of its own, that replace those with these keys."""
        layer = self.add(name, df)
        self.replace(name, self.keys(name, self.layer(name, layer)))
        return layer

    def layer(self, name: str, layer: str) -> DataFrame:
        """The rows of one layer with their places (layer, bucket, _row)."""
        return self.log.layered(self.spec(name), name, [layer])

    def delete(self, name: str, df: DataFrame) -> None:
        """Rows with the keys of these go."""
        self.replace(name, self.keys(name, df))

    def replace(self, name: str, keys: DataFrame) -> None:
        part = self.part(name)
        if part.replaced:
            raise ValueError(f"one change replaces rows of {name} once")
        part.replaced.append(keys)
        if name in self.base["tables"]:
            self.list_gone(name, keys, self.base["tables"][name])

    def list_gone(self, name: str, keys: DataFrame, own: dict) -> None:
        """Write the places of a table's rows with these keys."""
        place = f"G{uuid.uuid4().hex}"
        path = f"{self.log.folder}/{name}_gone/{place}"
        self.found(name, keys, own).select("layer", "_row").write.parquet(path)
        n = self.spark.read.schema("layer string, _row long").parquet(path).count()
        if n:
            self.part(name).gone[place] = n

    def rewrite(self, name: str, df: DataFrame | None = None) -> str:
        """Write a table anew as one layer, with the rows that it has or others."""
        own = self.log.table(self.base, name)
        layer = self.add(name, self.log.rows(own, name) if df is None else df)
        self.part(name).drops = sorted(own["layers"])
        return layer

    def rebase(self, latest: dict) -> None:
        """Put the change behind the versions that have been committed since its base."""
        for name in self.read_tables:
            if latest["tables"][name]["gone"] != self.base["tables"][name]["gone"]:
                raise Conflict(f"rows of {name} have gone")
        for name, part in self.parts.items():
            now, before = latest["tables"].get(name), self.base["tables"].get(name)
            if part.new:
                if now:
                    raise Conflict(f"there is a table {name} now")
                continue
            if part.drops is not None and (now["gone"] != before["gone"] or not set(part.drops) <= set(now["layers"])):
                raise Conflict(f"{name} has lost rows or layers")
            newer = now | {"layers": {k: n for k, n in now["layers"].items() if k not in before["layers"]}}
            if not set(before["layers"]) <= set(now["layers"]):  # rewritten meanwhile: all places are others
                part.gone.clear()
                newer = now
            for keys in part.replaced:
                self.list_gone(name, keys, newer)
            for keys in part.inserted:
                if self.found(name, keys, newer).limit(1).count() and newer is not now:
                    raise Conflict(f"{name} has some of these keys now")
        self.base = latest

    def merged(self) -> dict:
        tables = dict(self.base["tables"])
        for name, part in self.parts.items():
            own = dict(part.new or tables[name])
            layers, gone = dict(own["layers"]), dict(own["gone"])
            if part.drops is not None:
                layers, gone = {k: n for k, n in layers.items() if k not in part.drops}, {}
            tables[name] = own | {"layers": layers | part.layers, "gone": gone | part.gone}
        return {"version": self.base["version"] + 1, "tables": tables}

    def commit(self) -> int:
        """Make the change the next version; gives its number."""
        while True:
            latest = self.log.state()
            if latest["version"] != self.base["version"]:
                self.rebase(latest)
            state = self.merged()
            if create(self.spark, f"{self.log.folder}/log/{state['version']:012d}.json", json.dumps(state)):
                return state["version"]
