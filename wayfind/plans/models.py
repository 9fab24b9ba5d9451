"""Model plug-ins: a prompt in, an answer and a status out. Endpoints and keys come from the caller; none is built in.

A client is made once for each task. Errors are answers with a status, as they are in a chat.
"""

import json
import sys
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed package

#: Models that are tried, in this order, when one has gone; messages that say so; what each backend is asked
#: with, and how many seconds it has.
FALLBACKS = ["llama-3.1-8b-instant", "gemma2-9b-it", "mixtral-8x7b-32768"]
GONE = ("decommissioned", "not found")
SETTINGS = {
    "groq": {"temperature": 0.2, "max_tokens": 800, "top_p": 0.95, "stream": False},
    "huggingface": {"max_new_tokens": 600, "temperature": 0.2, "top_p": 0.95, "return_full_text": False},
    "ollama": {"temperature": 0.2, "num_predict": 700},
    "cohere": {"temperature": 0.4},
}
TIMEOUTS = {"groq": 30.0, "huggingface": 30.0, "ollama": 60.0, "cohere": 30.0}
#: Settings of the plain pipeline.
PLAIN = {"temperature": 0.1, "max_tokens": 500, "top_p": 1, "stream": False}
BACKENDS = ("extract", *SETTINGS)


class ModelError(Exception):
    """What a backend answered instead of a reply: the HTTP status, and the message in the answer's body."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    @property
    def gone(self) -> bool:
        return any(x in str(self).lower() for x in GONE)


@dataclass
class Extract:
    """Offline default: the first line of the context."""

    model: str = "extract"

    def __call__(self, prompt: str) -> str:
        body = prompt.partition("Context:\n")[2].partition("\n\nQuestion:")[0]
        return body.split("\n", 1)[0]


class Doubting(Extract):
    """An offline model that says so where the context names no edge."""

    def __call__(self, prompt: str) -> str:
        return super().__call__(prompt) if "→" in prompt or "--" in prompt else "There is not enough information."


def message_of(body: bytes) -> str:
    """The message in an error's body: JSON with error.message, error or message, or plain text."""
    text = body.decode("utf-8", "replace")
    try:
        found = json.loads(text)
    except ValueError:
        return text
    for key in ("error", "message"):
        found = found.get(key, found) if isinstance(found, dict) else found
    return found if isinstance(found, str) else text


@dataclass
class Http:
    """A backend behind HTTP. ``backend``: groq, huggingface, ollama or cohere, which differ in request and response.
    settings: what goes along with the prompt, instead of the backend's SETTINGS; system: a message before it (groq)."""

    backend: str
    url: str
    model: str = "N/A"
    key: str = ""
    timeout: float | None = None
    settings: dict | None = None
    system: str = ""
    post: Callable | None = None
    fallbacks: list[str] = field(default_factory=lambda: list(FALLBACKS))

    def __post_init__(self):
        if self.backend not in SETTINGS:
            raise ValueError(f"unknown backend {self.backend}")

    def __call__(self, prompt: str) -> str:
        """Answer of the model, or with groq of the next one that works if it has gone; the one tried last is used from then
        on."""
        try:
            return self.once(prompt)
        except ModelError as e:
            if self.backend != "groq" or not e.gone:
                raise
        gone = self.model
        for other in self.fallbacks:
            if other != gone:
                self.model = other
                try:
                    return self.once(prompt)
                except ModelError:
                    continue
        raise ModelError("no model is left that answers")

    def probe(self, others: tuple = (), prompt: str = "Hello") -> bool:
        """A test call at the start: whether the model answers, or else one of the others, which is used from then on."""
        for model in (self.model, *others):
            self.model = model
            try:
                self.once(prompt)
            except Exception:  # noqa: S112
                continue
            return True
        return False

    def body(self, prompt: str) -> dict:
        more = SETTINGS[self.backend] if self.settings is None else self.settings
        if self.backend == "groq":
            said = [{"role": "system", "content": self.system}] * bool(self.system) + [{"role": "user", "content": prompt}]
            return {"model": self.model, "messages": said, **more}
        if self.backend == "huggingface":
            return {"inputs": prompt, "parameters": dict(more)}
        if self.backend == "ollama":
            return {"model": self.model, "prompt": prompt, "stream": False, "options": dict(more)}
        return {"model": self.model, "message": prompt, **more}

    def once(self, prompt: str) -> str:
        out = (self.post or self.request)(self.body(prompt))
        if self.backend == "groq":
            return out["choices"][0]["message"]["content"].strip()
        if self.backend == "huggingface":
            return ((out[0] if isinstance(out, list) and out else out) or {}).get("generated_text", "").strip()
        return out.get("response" if self.backend == "ollama" else "text", "").strip()

    def request(self, body: dict):
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        call = urllib.request.Request(self.url, json.dumps(body).encode(), head)  # noqa: S310
        try:
            with urllib.request.urlopen(call, timeout=self.timeout or TIMEOUTS[self.backend]) as r:  # noqa: S310
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            raise ModelError(message_of(e.read()) or f"Status {e.code}", e.code) from e


def answered(rows: DataFrame, make: Callable, backend: str = "extract") -> DataFrame:
    """rows (qid, question, context, prompt) with answer, backend, model and status: one client for each task."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}")
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.StringType()) for c in ("answer", "backend", "model", "status"))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for p in parts:
            out = []
            for text in p["prompt"]:
                try:
                    out.append((client(text), client.model, "ok"))
                except Exception as e:
                    out.append((f"{backend} gave no answer: {e}", client.model, "error"))
            yield p.assign(answer=[a for a, *_ in out], backend=backend, model=["N/A" if backend == "huggingface" else m for _, m, _ in out], status=[s for *_, s in out])

    return rows.mapInPandas(run, schema)


def record(rows: DataFrame) -> DataFrame:
    """The answer record: lengths of the prompt and of the whole, uncapped context among its fields."""
    size = F.col("context_length") if "context_length" in rows.columns else F.length("context")
    return rows.select("qid", "question", "answer", "context", "backend", "model", F.length("prompt").cast("int").alias("prompt_length"), size.cast("int").alias("context_length"), "status")
