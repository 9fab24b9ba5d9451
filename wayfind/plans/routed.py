"""A model stage for tables of prompts: each row names its backend and model, calls are bounded, and none is made twice.

Equal prompts to one model are one call. Answers are kept under a hash of backend, model and prompt: first in a journal, a small
file for each that is written as soon as the answer is there, and with all others in a table when the stage is done. A task that is killed
and run again, or a job that is started again, asks only for what neither has. Each backend has a number of lanes, which are
tasks, a number of calls that a lane has open at a time, and a budget of calls a minute, of which every lane has its share. What fails is an
answer with a status; it isn't kept, and so is asked again the next time.
"""

import json
import sys
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.sources.log import Log

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANSWERS = "hash string, answer string, status string, model string"


@dataclass
class Route:
    """``make``: a function of a model's name that gives a client (a prompt in, an answer out). per_minute: calls of all lanes
    together, without a bound if it is None."""

    make: Callable
    lanes: int = 4
    open_calls: int = 4
    per_minute: float | None = None


class Pace:
    """At most ``per_minute`` calls a minute, evenly."""

    def __init__(self, per_minute: float | None, now: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.step, self.next, self.lock, self.now, self.sleep = 60 / per_minute if per_minute else 0.0, 0.0, threading.Lock(), now, sleep

    def wait(self) -> None:
        with self.lock:
            mine = max(self.now(), self.next)
            self.next = mine + self.step
        if mine > self.now():
            self.sleep(mine - self.now())


class Journal:
    """Answers by hash as files under a path of any file system that Arrow reads."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path, recursive=True)

    def get(self, key: str) -> dict | None:
        try:
            with self.fs.open_input_stream(f"{self.path}/{key}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, key: str, row: dict) -> None:
        with self.fs.open_output_stream(f"{self.path}/{key}.tmp") as f:
            f.write(json.dumps(row).encode())
        self.fs.move(f"{self.path}/{key}.tmp", f"{self.path}/{key}.json")


def asked(routes: dict[str, Route], path: str):
    """mapInPandas function over (hash, backend, lane, model, prompt), a lane after another: ANSWERS."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        journal, paces, clients, lock = Journal(path), {}, {}, threading.Lock()

        def one(row):
            old = journal.get(row.hash)
            if old is not None:
                return {"hash": row.hash, **old}
            route = routes[row.backend]
            key = row.backend, row.lane
            with lock:
                pace = paces.setdefault(key, Pace(route.per_minute and route.per_minute / route.lanes))
            pace.wait()
            try:
                name = None if pd.isna(row.model) else row.model
                with lock:
                    if (row.backend, name) not in clients:
                        clients[row.backend, name] = route.make(name)
                client = clients[row.backend, name]
                new = {"answer": client(row.prompt), "status": "ok", "model": getattr(client, "model", None) or name}
            except Exception as e:
                return {"hash": row.hash, "answer": f"{row.backend} gave no answer: {e}", "status": "error", "model": None}
            journal.put(row.hash, new)
            return {"hash": row.hash, **new}

        for part in parts:
            for (backend, _), own in part.groupby(["backend", "lane"], sort=False):
                with ThreadPoolExecutor(routes[backend].open_calls) as pool:
                    out = list(pool.map(one, own.itertuples()))
                yield pd.DataFrame(out, columns=["hash", "answer", "status", "model"])

    return run


def routed(rows: DataFrame, routes: dict[str, Route], log: Log) -> DataFrame:
    """rows (backend, model, prompt, ...) with answer, status and the model that answered. A backend that has no route is an error.
    Answers are kept in the table answers of ``log``, whose folder holds the journal too."""
    known = F.col("backend").isin(*routes)
    backend = F.when(known, F.col("backend")).otherwise(F.raise_error(F.concat(F.lit("no route to "), F.coalesce("backend", F.lit("null")))))
    named = rows.withColumn("backend", backend).withColumn("_hash", F.sha2(F.concat_ws("\x1f", "backend", F.coalesce("model", F.lit("")), F.coalesce("prompt", F.lit(""))), 256))
    wanted = named.filter("prompt is not null").select(F.col("_hash").alias("hash"), "backend", "model", "prompt").dropDuplicates(["hash"])
    if "answers" not in log.state()["tables"]:
        first = log.begin()
        first.create("answers", rows.sparkSession.createDataFrame([], ANSWERS), ["hash"])
        first.commit()
    old = log.read("answers")
    lanes = F.create_map(*[F.lit(x) for name, r in routes.items() for x in (name, r.lanes)])
    new = wanted.join(old, "hash", "left_anti").withColumn("lane", F.pmod(F.xxhash64("hash"), lanes[F.col("backend")]).cast("int"))
    dealt = new.repartition(sum(r.lanes for r in routes.values()), "backend", "lane").sortWithinPartitions("backend", "lane").select("hash", "backend", "lane", "model", "prompt")
    change = log.begin()
    layer = change.add("answers", dealt.mapInPandas(asked(routes, f"{log.folder}/journal"), ANSWERS))
    here = change.layer("answers", layer).select("hash", "answer", "status", F.col("model").alias("_model"))
    if here.filter("status <> 'ok'").limit(1).count():  # these rows are for this result, and not for the next one's
        change.parts["answers"].layers.clear()
        change.add("answers", change.layer("answers", layer).filter("status = 'ok'"))
    change.commit()
    all_ = old.select("hash", "answer", "status", F.col("model").alias("_model")).unionByName(here)
    done = named.join(all_.withColumnRenamed("hash", "_hash"), "_hash", "left")
    return done.withColumn("model", F.coalesce("_model", "model")).drop("_hash", "_model")
