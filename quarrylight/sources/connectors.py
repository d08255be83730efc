"""Connectors: page fetching, a search service as a Python data source, corpus ingestion, and writing to several sinks."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylight.functions.text import domain
from quarrylight.operators.corpus import corpus_issues, read_corpus
from quarrylight.operators.policy import OfficialSources, error_category
from quarrylight.sources.store import RunStore

AGENT, TIMEOUT = "quarrylight/0.1", 15.0
FETCHED = "url string, final_url string, status_code int, html string, error_kind string, message string"


def http_get(url: str, timeout: float = TIMEOUT) -> tuple[str, int, str]:
    """Final URL, status and text of a page."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as response:  # noqa: S310
        return response.geturl(), getattr(response, "status", None) or 200, response.read().decode("utf-8", "replace")


def fetch(urls: DataFrame, get: Callable[[str], tuple[str, int, str]] = http_get) -> DataFrame:
    """Pages of URLs, a domain's in one task; what fails is a row with its category."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, *get(url), None, None))
                except TimeoutError as e:
                    rows.append((url, None, None, None, "timeout", str(e)))
                except urllib.error.HTTPError as e:
                    rows.append((url, None, e.code, None, "http", str(e)))
                except urllib.error.URLError as e:
                    rows.append((url, None, None, None, "url", str(e)))
                except Exception as e:  # noqa: BLE001 - a page that fails is a row, not the end of the run
                    rows.append((url, None, None, None, type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.split(", ")])

    found = urls.select("url").repartition(domain(F.col("url"))).mapInPandas(run, FETCHED)
    category = F.when(F.col("error_kind").isNotNull(), error_category(F.col("status_code"), F.col("error_kind")))
    return found.withColumn("error_category", category).withColumn("is_error", F.col("error_kind").isNotNull())


class SearchSource(DataSource):
    """`search`: JSON responses of a search service, one row a term. Options: endpoint, terms (JSON list), limit, token."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "term string, body string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _SearchReader(dict(self.options))


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in json.loads(self.options["terms"])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str | None, str | None]]:
        term = partition.value
        query = urllib.parse.urlencode({"q": term, "count": self.options.get("limit", "10")})
        endpoint = self.options["endpoint"]
        url = endpoint if endpoint.startswith("file:") else f"{endpoint}?{query}"
        try:
            headers = {"User-Agent": AGENT, "Accept": "application/json", "X-Subscription-Token": self.options.get("token", "")}
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as r:  # noqa: S310
                yield term, r.read().decode("utf-8", "replace"), None
        except Exception as e:  # noqa: BLE001 - a search that fails is a row
            yield term, None, f"{type(e).__name__}: {e}"


def ingest(spark: SparkSession, store: RunStore, path: str, official: OfficialSources) -> dict[str, int]:
    """Read, check and upsert a corpus file, documents and chunks in one commit; fails with its issues if it has any (the first 50
    are named). Returns row counts."""
    head, documents, chunks = read_corpus(spark, path)
    issues = corpus_issues(head, documents, chunks, official).limit(50).collect()
    if issues:
        raise ValueError("invalid_corpus:" + ", ".join(f"{i['document_id']}:{i['reason']}" for i in issues))
    with store.transaction() as t:
        t.upsert("kb_documents", documents, "corpus_version", "document_id", partitions=("corpus_version",))
        t.upsert("kb_chunks", chunks, "corpus_version", "chunk_id", partitions=("corpus_version",))
    return {"documents": documents.count(), "chunks": chunks.count()}


def load_corpus(store: RunStore, corpus_version: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of a corpus version, in order of their ids; fails if there is none."""
    documents = store.read("kb_documents", corpus_version=corpus_version)
    if documents.isEmpty():
        raise KeyError(corpus_version)
    chunks = store.read("kb_chunks", corpus_version=corpus_version)
    return documents.orderBy("document_id"), chunks.orderBy("document_id", "chunk_index", "chunk_id")


def index_vectors(store: RunStore, vectors: DataFrame) -> None:
    """Upsert rows of a vector index (retrieval.index_rows): one row a chunk and index."""
    keys = ("corpus_version", "provider", "model", "version", "dimension", "metric", "chunk_id")
    store.upsert("kb_vectors", vectors, *keys, partitions=("corpus_version",))


def write_all(rows: DataFrame, *sinks: Callable[[DataFrame], None]) -> None:
    """The same rows to several sinks, computed once."""
    held = rows.persist()
    try:
        for sink in sinks:
            sink(held)
    finally:
        held.unpersist()
