"""A Python data source over providers of records: the plug-in surface, request budgets and retries.

A provider is any class with a ``name``, a constructor (folder, name) and
``fetch(ids)``; the option ``classes`` names one for each provider
("module:Class").  Without one, a provider reads what a fetcher has landed in a
folder.  The source cuts the wanted ids into batches; a provider's batches go to a
fixed number of partitions, and each of these waits that many intervals between
two calls, so that together they keep the provider's interval wherever they run.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds between two calls to a provider (and to any other), ids per call, and tries per call.
INTERVALS = {"crossref": 1.0, "openalex": 0.25, "arxiv": 0.5, "semantic_scholar": 0.35, "doi.org": 1.0}
OTHER_INTERVAL = 0.35
BATCH = 50
TRIES = 3
#: Tries, first wait and longest wait where a provider asks for fewer calls.
BUSY_TRIES, BUSY_WAIT, BUSY_MOST = 8, 2.0, 120.0


class TooManyRequests(OSError):
    """What a provider raises when it asks for fewer calls."""


class Provider(Protocol):
    """What a source of records has to offer."""

    name: str

    def fetch(self, ids: list[str]) -> dict[str, str]:
        """The JSON texts of the ids that the provider knows."""


class FolderProvider:
    """Records landed as ``<folder>/<name>/<id with / as _>.json``; stands in for a live provider without a network."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name

    def fetch(self, ids: list[str]) -> dict[str, str]:
        found = {}
        for i in ids:
            path = os.path.join(self.folder, self.name, i.replace("/", "_") + ".json")
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    found[i] = f.read()
        return found


def provider_of(spec: str | None, folder: str, name: str) -> Provider:
    """The provider that "module:Class" names; the landed folder if it names none."""
    if not spec:
        return FolderProvider(folder, name)
    module, _, cls = spec.partition(":")
    return getattr(importlib.import_module(module), cls)(folder, name)


class Budget:
    """Keeps an interval between two calls."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.last: float | None = None

    def acquire(self) -> None:
        if self.last is not None and (wait := self.interval - (self.clock() - self.last)) > 0:
            self.sleep(wait)
        self.last = self.clock()


def fetch_with_retry(provider: Provider, ids: list[str], tries: int = TRIES, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, budget: Budget | None = None) -> dict[str, str]:
    """The provider's answer, tried again after ``wait``, twice ``wait`` and so on; the last error is raised.

    A provider that asks for fewer calls is given twice as long each time, up to two
    minutes, and more tries.  Every call keeps the budget.
    """
    n = busy = 0
    while True:
        if budget:
            budget.acquire()
        try:
            return provider.fetch(ids)
        except TooManyRequests:
            busy += 1
            if busy == BUSY_TRIES:
                raise
            sleep(min(BUSY_MOST, BUSY_WAIT * 2 ** (busy - 1)))
        except OSError:
            n += 1
            if n == tries:
                raise
            sleep(wait * n)


class IdBatches(InputPartition):
    """Batches of ids that one partition asks a provider for, and how many partitions ask it."""

    def __init__(self, provider: str, batches: list[list[str]], sharing: int):
        super().__init__(0)
        self.provider, self.batches, self.sharing = provider, batches, sharing


class LandingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["folder"]
        self.providers = [p for p in options.get("providers", "").split(",") if p]
        self.ids = json.loads(options.get("ids", "{}"))
        if options.get("requests"):
            self.ids = _requested(options["requests"], self.ids)
        self.classes = json.loads(options.get("classes", "{}"))
        self.intervals = INTERVALS | json.loads(options.get("intervals", "{}"))
        self.parallel = max(1, int(options.get("parallel", "4")))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.providers or sorted(self.ids):
            ids = list(dict.fromkeys(self.ids.get(p, [])))
            batches = [ids[i : i + BATCH] for i in range(0, len(ids), BATCH)]
            n = min(self.parallel, len(batches))
            out += [IdBatches(p, batches[k::n], n) for k in range(n)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name = partition.provider
        provider = provider_of(self.classes.get(name), self.folder, name)
        # what has landed in a folder is no call to anyone
        budget = None if isinstance(provider, FolderProvider) else Budget(self.intervals.get(name, OTHER_INTERVAL) * partition.sharing)
        for ids in partition.batches:
            got = fetch_with_retry(provider, ids, budget=budget)
            for i in ids:
                yield (name, i, got.get(i), i in got)


def _requested(path: str, ids: dict[str, list[str]]) -> dict[str, list[str]]:
    """Ids listed one a line as provider, tab, id in the files of a folder, which the driver reads; added to ``ids``."""
    out = {k: list(v) for k, v in ids.items()}
    for name in sorted(os.listdir(path)):
        with open(os.path.join(path, name), encoding="utf-8") as f:
            for line in f:
                provider, _, i = line.rstrip("\n").partition("\t")
                if i:
                    out.setdefault(provider, []).append(i)
    return out


class LandingSource(DataSource):
    """``spark.read.format("citeloom_landing")``.

    Options: folder; providers (names with commas); ids (JSON: provider to list of
    ids) or requests (a folder of lists); classes (JSON: provider to "module:Class");
    intervals (JSON: provider to seconds); parallel (partitions for each provider, 4).
    The ids of one read pass through the driver: cut larger requests into reads (see
    ``operators.lookup.missing_batches``).  Ids that the provider does not know come
    back with a null payload and ``found`` false, so that misses are rows and not
    errors.
    """

    @classmethod
    def name(cls) -> str:
        return "citeloom_landing"

    def schema(self) -> str:
        return "source string, source_id string, payload string, found boolean"

    def reader(self, schema) -> DataSourceReader:
        return LandingReader(self.options)
