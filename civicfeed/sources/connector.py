"""Sources of articles as a streaming data source whose offset is the collection cursor (CN1 to CN11, ST1)."""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from pathlib import Path
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.errors import PySparkNotImplementedError
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from . import cursors

SCHEMA = "source_key string, external_id string, title string, body string, url string, published_at string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: How each source's listings are walked: by days or months back in time, by pages, by ids downwards, or through a sitemap.
WALKS = {
    "tass": "sitemap", "ria": "day", "kommersant": "day", "m24": "probe", "msk1": "page", "mskagency": "page",
    "pik_comfort": "page", "granel": "page", "zhil_nagatino": "page", "gbu_portal": "page", "moek": "month",
}


def local_pages(options: dict[str, str], cursor: str) -> list[dict]:
    """The rows of one listing from a folder that has a JSON-lines file for each day, month, page or id."""
    file = Path(options["path"]) / f"{cursor.replace(':', '_')}.jsonl"
    return [json.loads(x) for x in file.read_text().splitlines() if x.strip()] if file.exists() else []


def fetch(options: dict[str, str], listing: str) -> list[dict]:
    """The rows of a listing, by the function that the options name; from the log if they are there."""
    if "log" in options:
        return logged(options, listing)
    module, _, name = options.get("fetch", f"{__name__}:local_pages").partition(":")
    return getattr(importlib.import_module(module), name)(options, listing)


def logged(options: dict[str, str], listing: str) -> list[dict]:
    """``fetch`` through a log: what is fetched first is written before it is used, and from then on is what the listing says.

    So a batch that is replayed has the rows that it had, whatever the page has become. ``log`` is a folder that driver and
    executors share (a path or a URI of file, hdfs, s3 or gs). Writers write apart and rename; of two at once the
    rows that are there after the rename hold for both.
    """
    uri = options["log"].rstrip("/")
    fs, root = pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)
    path = f"{root}/{options.get('source_key', 'pages')}/{quote(listing, safe='')}.jsonl"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        rows = fetch({k: v for k, v in options.items() if k != "log"}, listing)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        apart = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(apart) as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            fs.move(apart, path)
        else:
            fs.delete_file(apart)
    with fs.open_input_stream(path) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def tuples(options: dict[str, str], rows: list[dict]) -> Iterator[tuple]:
    """Rows in the order of SCHEMA, less those that were published before ``since``."""
    since, key = options.get("since", ""), options.get("source_key")
    fresh = (r for r in rows if not r.get("published_at") or r["published_at"][: len(since)] >= since)
    return iter([tuple(r.get(f, key) if f == "source_key" else r.get(f) for f in FIELDS) for r in fresh])


def all_old(options: dict[str, str], rows: list[dict]) -> bool:
    """Whether a listing has rows and all of them are from before ``since``."""
    since = options.get("since", "")
    return bool(rows) and all((r.get("published_at") or "9")[: len(since) or 1] < since for r in rows)


class ArticleSource(DataSource):
    """``spark.readStream.format("articles")``, after ``spark.dataSource.register(ArticleSource)``.

    Options: source_key; walk (by default that of the source); since and today (ISO dates); fetch, "module:function" of
    (options, cursor) to rows, by default files under path; log, a shared folder in which fetched rows are kept, so that a
    replayed batch is what it was and nothing is fetched twice. Days and months are known beforehand: all that are due are
    one micro-batch, a task for each listing. Pages, ids and sitemaps are read one listing a batch, since what one has
    decides about the next. Rows from before ``since`` are left out, and listings that have nothing else end a walk.
    """

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return SCHEMA

    def _walk(self) -> str:
        return self.options.get("walk") or WALKS.get(self.options.get("source_key", ""), "page")

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        if self._walk() not in ("day", "month"):
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader"})
        return DatedReader(dict(self.options), self._walk())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return ListingReader(dict(self.options), self._walk())


@dataclass
class Listing(InputPartition):
    cursor: str


class DatedReader(DataSourceStreamReader):
    """Days or months from ``today`` back to ``since``; an offset is how many of them have been read."""

    def __init__(self, options: dict[str, str], walk: str) -> None:
        self.options = options
        today, since = (date.fromisoformat(options[k]) for k in ("today", "since"))
        self.listings, cursor = [], None
        while not self.listings or cursor is not None:
            if walk == "day":
                day, cursor = cursors.next_day(cursor, today, since)
                self.listings.append(day.strftime("%Y%m%d"))
            else:
                month, cursor = cursors.next_month(cursor, today, since)
                self.listings.append(month)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"read": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"read": len(self.listings)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Listing(x) for x in self.listings[start["read"] : end["read"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return tuples(self.options, fetch(self.options, partition.cursor))


class ListingReader(SimpleDataSourceStreamReader):
    """Pages from the first, ids downwards from ``first``, or a sitemap in steps; the offset has the next cursor, or that the walk is over."""

    def __init__(self, options: dict[str, str], walk: str) -> None:
        self.options, self.walk = options, walk

    def initialOffset(self) -> dict:  # noqa: N802
        first = {"probe": self.options.get("first", "1"), "sitemap": "0:0"}.get(self.walk, "1")
        return {"cursor": first, "misses": 0, "over": False}

    def _after(self, start: dict, rows: list[dict]) -> dict:
        cursor, misses = start["cursor"], start["misses"]
        if self.walk == "probe":
            number, misses = cursors.next_probe(int(cursor), bool(rows), misses, int(self.options.get("misses", "50")))
            after = None if number is None else str(number)
        elif self.walk == "sitemap":
            misses = 0 if rows else misses + 1
            size, step = int(self.options.get("size", "0")), int(self.options.get("step", "100"))
            after = cursors.next_sitemap(cursor, size, step, misses)
        else:
            after = cursors.next_page(cursor, len(rows), all_old(self.options, rows))
        return {"cursor": after or cursor, "misses": misses, "over": after is None or (self.walk != "page" and all_old(self.options, rows))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["over"]:
            return iter([]), start
        rows = fetch(self.options, start["cursor"])
        return tuples(self.options, rows), self._after(start, rows)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([]) if start["over"] else tuples(self.options, fetch(self.options, start["cursor"]))
