"""Answering many requests from one session: tools by name, cached answers, bounded concurrency and time, contracts, checks of negative answers."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


class Tools:
    """Callables by name; a name is given once."""

    def __init__(self) -> None:
        self.known: dict[str, Callable] = {}

    def register(self, name: str, run: Callable) -> None:
        if name in self.known:
            raise ValueError(f"{name} is taken")
        self.known[name] = run

    def run(self, name: str, *args, **kwargs):
        if name not in self.known:
            raise KeyError(name)
        return self.known[name](*args, **kwargs)


class Answers:
    """Answers kept for ``seconds``, at most ``most`` of them, the longest unused going first. Safe for several threads."""

    def __init__(self, seconds: float = 600, most: int = 500, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.most, self.clock = seconds, most, clock
        self.kept: OrderedDict[str, tuple[float, object]] = OrderedDict()
        self.lock = threading.Lock()

    def get(self, key: str):
        with self.lock:
            at, value = self.kept.get(key, (None, None))
            if at is None:
                return None
            if self.clock() - at > self.seconds:
                del self.kept[key]
                return None
            self.kept.move_to_end(key)
            return value

    def put(self, key: str, value) -> None:
        with self.lock:
            self.kept[key] = (self.clock(), value)
            self.kept.move_to_end(key)
            while len(self.kept) > self.most:
                self.kept.popitem(last=False)


def run_all(jobs: list[Callable], concurrency: int = 4) -> list:
    """The results of the jobs in their order, at most ``concurrency`` at a time; a job that fails gives its exception."""

    def one(job: Callable):
        try:
            return job()
        except Exception as e:  # noqa: BLE001
            return e

    if not jobs:
        return []
    with ThreadPoolExecutor(max(1, concurrency)) as pool:
        return list(pool.map(one, jobs))


def run_within(spark: SparkSession, seconds: float, job: Callable):
    """What the job returns, if it ends in time; else its Spark jobs are cancelled and TimeoutError is raised."""
    group, out = uuid.uuid4().hex, {}

    def work() -> None:
        spark.sparkContext.setJobGroup(group, "bounded in time", interruptOnCancel=True)
        try:
            out["value"] = job()
        except BaseException as e:  # noqa: BLE001
            out["error"] = e

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        thread.join(10)
        raise TimeoutError(f"not done in {seconds} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


def contract(specs: DataFrame, rules: DataFrame) -> dict:
    """{models, relationships, hash} of a container's entity specs and join rules: both are a row for a file or a join of one container, so they fit the driver. The hash does not turn on the order of rows."""
    rows = lambda df: sorted((json.loads(r) for r in df.toJSON().collect()), key=lambda x: json.dumps(x, sort_keys=True))
    body = {"models": rows(specs), "relationships": rows(rules)}
    return body | {"hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


NEGATIVE = re.compile(r"\b(?:no|not|none|never|without|cannot|zero|nothing|missing|absent)\b", re.IGNORECASE)
PROBE = re.compile(r"\b(?:min|max)\s*\(|\bdistinct\b", re.IGNORECASE)


def negative_claim(answer: str, log: list[tuple[str, set[str]]], parts: set[str]) -> dict[str, bool]:
    """Whether an answer denies something, and if so whether it is proven: the log(statement, parts read) has read all parts and looked at a column's range or values."""
    if not NEGATIVE.search(answer or ""):
        return {"negative": False, "proven": True}
    read = set().union(*(p for _, p in log)) if log else set()
    covered, probed = parts <= read, any(PROBE.search(q) for q, _ in log)
    return {"negative": True, "covered": covered, "diagnosed": covered and probed, "proven": covered and probed}
