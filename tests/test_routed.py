"""Models by row: one call for equal prompts, none twice, bounded and paced."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tests.test_graph import Backend
from wayfind.plans import models as M
from wayfind.plans import routed as R
from wayfind.sources.log import Log

ROWS = "qid int, backend string, model string, prompt string"


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, f"file://{tmp_path}/answers")


def http(url, backend="ollama"):
    return lambda model: M.Http(backend, url, model or "m")


def test_each_prompt_is_asked_once(spark, log):
    with Backend(lambda b: (500, {"error": "down"}) if b["prompt"] == "p3" and not again else (200, {"response": f"{b['model']}:{b['prompt']}"})) as one, Backend(lambda b: (200, {"text": "co " + b["message"]})) as two:
        again = []
        routes = {"ollama": R.Route(http(one.url), 3, 2), "cohere": R.Route(http(two.url, "cohere"), 1)}
        rows = [(i, "ollama", ["a", "b"][i % 2], f"p{i % 7}") for i in range(40)] + [(100, "cohere", None, "p1"), (101, "cohere", None, "p1"), (102, "cohere", None, None)]
        df = spark.createDataFrame(rows, ROWS).repartition(5)
        got = {r.qid: r for r in R.routed(df, routes, log).collect()}
        assert len(got) == 43 and len(one.seen) == 14 and len(two.seen) == 1
        assert got[4].answer == "a:p4" and got[5].answer == "b:p5" and got[101].answer == "co p1" and got[102].answer is None
        assert (got[3].status, got[10].status, got[4].status) == ("error", "error", "ok") and "down" in got[3].answer
        again.append(1)
        more = df.unionByName(spark.createDataFrame([(200, "ollama", "a", "new")], ROWS))
        got = {r.qid: r for r in R.routed(more, routes, log).collect()}
        assert got[3].answer == "b:p3" and got[200].answer == "a:new" and len(one.seen) == 14 + 3 and len(two.seen) == 1
    with pytest.raises(Exception, match="no route to other"):
        R.routed(df.withColumn("backend", F.lit("other")), routes, log).collect()


def test_a_task_that_dies_repeats_no_call(spark, log):
    """The journal has what was answered before the end, though nothing was committed."""
    with Backend(lambda b: (200, {"response": "yes"})) as server:

        class Dies:
            model = "m"

            def __init__(self, url):
                self.client, self.left = M.Http("ollama", url, "m"), 3

            def __call__(self, prompt):
                if not self.left:
                    raise KeyboardInterrupt  # nothing that a client's errors are
                self.left -= 1
                return self.client(prompt)

        url = server.url
        df = spark.createDataFrame([(i, "ollama", "m", f"p{i}") for i in range(8)], ROWS)
        with pytest.raises(Exception, match="KeyboardInterrupt|Python worker"):
            R.routed(df, {"ollama": R.Route(lambda _: Dies(url), 1, 1)}, log).collect()
        assert len(server.seen) == 3 and log.read("answers").count() == 0
        assert R.routed(df, {"ollama": R.Route(http(url), 1, 1)}, log).filter("answer = 'yes'").count() == 8
        assert sorted(b["prompt"] for b in server.seen) == [f"p{i}" for i in range(8)]


def test_open_calls_and_pace(spark, log):
    held, most, lock = [], [], threading.Lock()

    def slow(body):
        with lock:
            held.append(1)
            most.append(len(held))
        time.sleep(0.05)
        with lock:
            held.pop()
        return 200, {"response": "x"}

    with Backend(slow) as server:
        df = spark.createDataFrame([(i, "ollama", "m", f"p{i}") for i in range(24)], ROWS)
        assert R.routed(df, {"ollama": R.Route(http(server.url), 1, 3)}, log).filter("status = 'ok'").count() == 24
        assert 1 < max(most) <= 3
    now, slept = [0.0], []
    pace = R.Pace(120, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(5):
        pace.wait()
    assert slept == [0.5] * 4
    R.Pace(None).wait()
