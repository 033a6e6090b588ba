"""Remote tables: literature pages, vocabularies and model answers, with the client handed in."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "source string, title string, abstract string, year int, doi string, url string"


def abstract_of(index: dict | None) -> str | None:
    """A text from its words' positions, in order; gaps are dropped."""
    if not index:
        return None
    return " ".join(w for _, w in sorted((p, w) for w, ps in index.items() for p in ps))


def paged_corpus(spark: SparkSession, fetch: Callable[[str, str], dict], queries: list[str], pages: int = 50, source: str = "api") -> DataFrame:
    """Corpus rows of cursor-paged answers {"results": [...], "meta": {"next_cursor"}}; a query is a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q in batch["query"]:
                cursor = "*"
                for _ in range(pages):
                    answer = fetch(q, cursor)
                    rows = [
                        (source, r.get("title"), r.get("abstract") or abstract_of(r.get("abstract_inverted_index")), r.get("publication_year"), (r.get("doi") or "").lower().removeprefix("https://doi.org/") or None, r.get("url") or r.get("id"))
                        for r in answer.get("results", [])
                    ]
                    yield pd.DataFrame(rows, columns=["source", "title", "abstract", "year", "doi", "url"]).astype({"year": "Int32"})
                    cursor = answer.get("meta", {}).get("next_cursor")
                    if not cursor:
                        break

    asked = spark.createDataFrame([(q,) for q in queries], "query string").repartition(max(1, len(queries)))
    return asked.mapInPandas(run, CORPUS)


def vocabulary_request(term: str, lang: str = "en", limit: int = 20) -> str:
    """A SPARQL query for labels like a term, whose underscores are blanks there."""
    safe = term.replace("_", " ").replace("\\", "\\\\").replace('"', '\\"')
    return f'PREFIX skos: <http://www.w3.org/2004/02/skos/core#> SELECT ?c ?l WHERE {{ ?c skos:prefLabel ?l . FILTER(lang(?l) = "{lang}" && contains(lcase(str(?l)), lcase("{safe}"))) }} LIMIT {limit}'


def bindings(answer: str) -> list[tuple[str, str]]:
    """Concept and label of a SPARQL answer in JSON."""
    rows = json.loads(answer).get("results", {}).get("bindings", [])
    return [(r["c"]["value"], r["l"]["value"]) for r in rows if "c" in r and "l" in r]


def model_answers(df: DataFrame, text: str, ask: Callable[[str], str], prompt: str, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """df with `answer` and `error`: one request a row, tried again after 1, 2, 4 waits. An empty answer is none, but no
    error."""
    at = df.columns.index(text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for t in batch.iloc[:, at]:
                answer, error = None, None
                for k in range(tries):
                    try:
                        answer, error = ask(prompt + "\n" + (t or "")), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises is told in the row
                        error = str(e)
                        if k + 1 < tries:
                            time.sleep(wait * 2**k)
                answers.append(answer)
                errors.append(error)
            yield batch.assign(answer=answers, error=errors)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", answer string, error string"
    return df.mapInPandas(run, schema)


def cached_answers(df: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose answer is known, rows still to ask), by md5 of the key columns."""
    keyed = df.withColumn("cache_key", F.md5(F.concat_ws("|", *key)))
    return keyed.join(cache.select("cache_key", "answer"), "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def tile_cells(spark: SparkSession, layers: dict[str, Callable[[int, int], float]], rows: int, cols: int) -> DataFrame:
    """row, col, band, value of raster layers given as functions; a row of cells is a unit of work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch["id"]:
                yield pd.DataFrame([(int(r), c, b, float(f(int(r), c))) for b, f in layers.items() for c in range(cols)], columns=["row", "col", "band", "value"])

    return spark.range(rows).mapInPandas(run, "row int, col int, band string, value double")


def unavailable(name: str) -> Callable:
    """A source that is only named: asking it is an error that says so."""

    def ask(*_args, **_kwargs):
        raise NotImplementedSource(f"[{name}] this source needs an account and a client of its own\nHint: read its files and use tile_cells()")

    return ask


class NotImplementedSource(RuntimeError):
    """Raised by sources that can't be read here."""


def paged_request(query: str, cursor: str = "*", size: int = 200, first_year: int | None = None, last_year: int | None = None, contact: str | None = None) -> dict:
    """Parameters of a page of a cursor-paged literature service."""
    years = [f"from_publication_date:{first_year}-01-01"] * (first_year is not None) + [f"to_publication_date:{last_year}-12-31"] * (last_year is not None)
    return {"search": query, "per-page": size, "cursor": cursor} | ({"filter": ",".join(years)} if years else {}) | ({"mailto": contact} if contact else {})


def window(cells: DataFrame, row: int, col: int, size: int) -> DataFrame:
    """A square patch around a cell; with Parquet sorted by cell the predicate skips row groups."""
    half = size // 2
    return cells.filter(F.col("row").between(row - half, row + size - half - 1) & F.col("col").between(col - half, col + size - half - 1))
