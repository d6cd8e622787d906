"""Captured answers of paged endpoints, put in the order of their links.

    spark.dataSource.register(PagedCaptures)
    spark.read.format("paged_captures").option("path", "/captures").load().where("endpoint = 'repos/o/r/pulls'")

A capture is a file of JSON lines for each endpoint, whose name is the
endpoint's, slashes as ``%2F``: one line a page, {"url", "link", "body"}, where
link is the answer's Link header.  Lines may be in any order; of two with one
url the last counts.

An endpoint is read by one task, which reads many small ones one after the other;
filters on ``endpoint`` leave the other files
alone.  A page's items come by its place in the chain of next links; of a page
only url, next link and place in the file are held.  What is wrong is a row
without a value: ``lost`` (a next link to a page that isn't there), ``loop`` (to
one that was given already), ``unreadable`` (a line).  Chains start with pages
that no other leads to, in the order of the file; a ring starts with its first.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from provmill.sources.line_files import local_path

SCHEMA = "endpoint string, page int, item int, url string, value string, problem string"
#: A next link in a Link header (a fixed pattern).
NEXT = re.compile(r'<([^>]*)>[^,]*;\s*rel="?next"?')


def file_of(endpoint: str) -> str:
    return quote(endpoint, safe="") + ".jsonl"


class Endpoint(InputPartition):
    def __init__(self, name: str, file: str) -> None:
        self.name, self.file = name, file


#: Endpoints that a task reads one after the other, as a task for each of many small files takes longer to start than to run; fewer if they come to so many bytes.
ENDPOINTS_IN_A_TASK, BYTES_IN_A_TASK = 256, 64 << 20


class Endpoints(InputPartition):
    """Endpoints that one task reads."""

    def __init__(self, parts: list[Endpoint]) -> None:
        self.parts = parts


def dealt(parts: Iterable[Endpoint]) -> list[Endpoints]:
    """Endpoints in their order, as many to a task as it takes."""
    out, left = [], 0
    for part in parts:
        size = os.path.getsize(part.file)
        if not out or size > left or len(out[-1].parts) >= ENDPOINTS_IN_A_TASK:
            out.append(Endpoints([]))
            left = BYTES_IN_A_TASK
        out[-1].parts.append(part)
        left -= size
    return out


def chain(pages: dict[str, str | None]) -> Iterator[tuple[str, str | None]]:
    """(url, None) in order of links, and (url, problem) where a link leads nowhere; ``pages`` has the next url of each."""
    led_to, given = {n for u, n in pages.items() if n != u}, set()
    for start in [*(u for u in pages if u not in led_to), *pages]:
        at = start
        while at is not None and at not in given:
            given.add(at)
            yield at, None
            after = pages[at]
            if after is not None and after not in pages:
                yield after, "lost"
                after = None
            elif after in given:
                yield after, "loop"
            at = after


def read_endpoint(part: Endpoint) -> Iterator[tuple]:
    places, pages, bad = {}, {}, []
    with open(part.file, "rb") as f:
        at = 0
        for line in f:
            try:
                page = json.loads(line)
                url, link = page["url"], page.get("link") or ""
                found = NEXT.search(link)
                places[url], pages[url] = at, found[1] if found else None
            except (ValueError, KeyError, TypeError, AttributeError):
                if line.strip():
                    bad.append(at)
            at += len(line)
        n = -1
        for url, problem in chain(pages):
            if problem:
                yield part.name, n, None, url, None, problem
                continue
            n += 1
            f.seek(places[url])
            body = json.loads(f.readline()).get("body")
            for i, item in enumerate(body if isinstance(body, list) else [] if body is None else [body]):
                yield part.name, n, i, url, json.dumps(item, ensure_ascii=False, separators=(",", ":")), None
    for at in bad:
        yield part.name, None, at, None, None, "unreadable"


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.names = local_path(folder), None

    def partitions(self) -> list[Endpoints]:
        files = sorted(glob.glob(f"{glob.escape(self.folder)}/*.jsonl")) if self.names is None else [f"{self.folder}/{file_of(n)}" for n in sorted(self.names)]
        return dealt(Endpoint(unquote(os.path.basename(f).removesuffix(".jsonl")), f) for f in files if os.path.exists(f))

    def read(self, partition: Endpoints) -> Iterator[tuple]:
        for part in partition.parts:
            yield from read_endpoint(part)


class _Filtering(_Reader):
    """With filters on the endpoint; Spark refuses it where their setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("endpoint",):
                self.names = values if self.names is None else self.names & values
            else:
                yield f


class PagedCaptures(DataSource):
    """Options: path (a folder), pushdown (whether filters on the endpoint are taken over)."""

    @classmethod
    def name(cls) -> str:
        return "paged_captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_Filtering if self.options.get("pushdown") == "true" else _Reader)(self.options["path"])


def items(spark: SparkSession, folder: str) -> DataFrame:
    """All items of the captures in a folder, with their problems.

    Filters on ``endpoint`` are pushed down if
    spark.sql.python.filterPushdown.enabled is set.
    """
    spark.dataSource.register(PagedCaptures)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("paged_captures").option("path", folder).option("pushdown", pushdown).load()
