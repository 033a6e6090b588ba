"""Cursor-paged literature services as a Spark data source, for tables and for streams."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

from loamwork.sources.services import CORPUS, abstract_of, paged_request

#: The first page's cursor, and the one after the last page.
FIRST, ENDED = "*", ""


def record(query: str, r: dict) -> tuple:
    """A row of the corpus from one of a page's results; the identifier is the address, else the DOI, else the title."""
    doi = (r.get("doi") or "").lower().removeprefix("https://doi.org/").removeprefix("http://doi.org/") or None
    year = r.get("publication_year")
    return query, r.get("id") or doi or r.get("title"), r.get("title"), r.get("abstract") or abstract_of(r.get("abstract_inverted_index")), int(year) if year is not None else None, doi, r.get("url") or r.get("id")


class Pages:
    """The pages of a query, one request each, tried again after 1, 2, 4 waits."""

    def __init__(self, options: dict, client: Callable[[str, str], dict] | None):
        self.client = client
        self.url, self.timeout = options.get("url"), float(options.get("timeout", "120"))
        self.size, self.contact = int(options.get("size", "200")), options.get("contact")
        self.first, self.last = (int(options[k]) if options.get(k) else None for k in ("fromYear", "toYear"))
        self.most = int(options["maxResults"]) if options.get("maxResults") else None
        self.tries, self.wait = int(options.get("tries", "3")), float(options.get("wait", "1"))
        if client is None and not self.url:
            raise ValueError("[literature] option url is missing\nHint: or hand a client in with literature(client)")

    def ask(self, query: str, cursor: str) -> dict:
        for k in range(self.tries):
            try:
                if self.client is not None:
                    return self.client(query, cursor)
                asked = urllib.parse.urlencode(paged_request(query, cursor, self.size, self.first, self.last, self.contact))
                with urllib.request.urlopen(f"{self.url}?{asked}", timeout=self.timeout) as answer:  # noqa: S310
                    return json.load(answer)
            except Exception:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)
        raise AssertionError

    def page(self, query: str, at: dict) -> tuple[list[tuple], dict]:
        """The rows of the page at an offset {cursor, n: rows before it}, and the offset after it."""
        answer = self.ask(query, at["cursor"])
        rows = [record(query, r) for r in answer.get("results") or []]
        over = (answer.get("meta") or {}).get("next_cursor") or ENDED
        n = at["n"] + len(rows)
        if self.most is not None and n >= self.most:
            rows, n, over = rows[: self.most - at["n"]], self.most, ENDED
        return rows, {"cursor": str(over) if rows else ENDED, "n": n}


class Query(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)


class PagedReader(DataSourceReader):
    """A query is a task, which walks through its pages; a filter on the query leaves the others unasked."""

    def __init__(self, pages: Pages, queries: list[str]):
        self.pages, self.queries = pages, queries

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",):
                self.queries = [q for q in self.queries if q == f.value]
            elif isinstance(f, In) and f.attribute == ("query",):
                self.queries = [q for q in self.queries if q in f.value]
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Query(q) for q in self.queries]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no query is left
            return
        at = {"cursor": FIRST, "n": 0}
        while at["cursor"] != ENDED:
            rows, at = self.pages.page(partition.value, at)
            yield from rows


class PagedStream(SimpleDataSourceStreamReader):
    """The offset is the next cursor of each query. A batch is `pagesPerBatch` pages of each; after a restart it goes on
    from the last offset, and a batch that was cut short is asked for again between its own offsets."""

    def __init__(self, pages: Pages, queries: list[str], per_batch: int):
        self.pages, self.queries, self.per_batch = pages, queries, per_batch

    def initialOffset(self) -> dict:  # noqa: N802
        return {q: {"cursor": FIRST, "n": 0} for q in self.queries}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = [], dict(start)
        for q in self.queries:
            for _ in range(self.per_batch):
                # a query that joins later begins at its first page
                at = after.setdefault(q, {"cursor": FIRST, "n": 0})
                if at["cursor"] == ENDED:
                    break
                more, after[q] = self.pages.page(q, at)
                rows += more
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for q, stop in end.items():
            at = start.get(q, {"cursor": FIRST, "n": 0})
            while at["n"] < stop["n"] and at["cursor"] != ENDED:
                rows, at = self.pages.page(q, at)
                yield from rows


class Literature(DataSource):
    """spark.read.format("literature") and spark.readStream.format("literature").

    Options: queries (a JSON list), url, fromYear, toYear, contact, size (results a page), maxResults (of a query),
    pagesPerBatch (1), tries, wait, timeout. A request that still fails after its tries fails the task or the batch, and
    with it nothing that was read before.
    """

    client: Callable[[str, str], dict] | None = None

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return f"query string, {CORPUS}"

    def _queries(self) -> list[str]:
        queries = json.loads(self.options.get("queries", "[]"))
        if not queries or not all(isinstance(q, str) and q for q in queries):
            raise ValueError("[literature] option queries must be a JSON list of texts")
        return list(dict.fromkeys(queries))

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(Pages(self.options, type(self).client), self._queries())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return PagedStream(Pages(self.options, type(self).client), self._queries(), int(self.options.get("pagesPerBatch", "1")))


def literature(client: Callable[[str, str], dict]) -> type[Literature]:
    """The data source with a client of one's own: client(query, cursor) gives a page {"results": [...], "meta":
    {"next_cursor"}}."""
    return type("Literature", (Literature,), {"client": staticmethod(client)})


def register(spark: SparkSession, client: Callable[[str, str], dict] | None = None) -> None:
    """Makes the format known to the session, and lets filters reach data sources in Python, which it asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Literature if client is None else literature(client))
