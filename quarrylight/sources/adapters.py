"""Other ways to a page: a browser, a scraping service, a crawler, the best extractor at hand — each an injected function that runs
where the URLs are. What fails is a row with its category, never the end of a run."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import UNKNOWN, domain, normalize_url
from quarrylight.operators.pages import LOW_TEXT, SHELL_MARKS, read_html
from quarrylight.operators.policy import scrape_reason

PAGE = "site string, url string, status_code int, title string, main_text string, strategy string, error_type string, error_category string"
_NAMES = [c.split()[0] for c in PAGE.split(", ")]
# Where a service or a crawler keeps a page's text, in order of trial.
SERVICE_TEXTS = ("markdown", "text", "content", "html")
CRAWL_TEXTS = ("main_text", "text", "content", "body", "html")
CODES = ("status_code", "statusCode")


def optional(module: str, name: str) -> Callable | None:
    """A function of a library that may not be installed."""
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError):
        return None


def _said(document: Mapping, keys: tuple[str, ...]) -> str:
    return next((" ".join(str(document[k]).split()) for k in keys if document.get(k)), "")


def _code(*documents: Mapping) -> int:
    return next((d[k] for d in documents for k in CODES if isinstance(d.get(k), int)), 200)


def _page(site: str, document: Mapping, keys: tuple[str, ...], strategy: str, empty: str, about: Mapping | None = None) -> tuple:
    """One row of PAGE from what a service or crawler gave for a page."""
    about = about or {}
    url = about.get("sourceURL") or about.get("url") or document.get("url") or site
    title = " ".join(str(about.get("title") or document.get("title") or UNKNOWN).split())
    text = _said(document, keys)
    if not text:
        return (site, str(url), _code(document, about), None, None, strategy, "EmptyContent", empty)
    return (site, str(url), _code(document, about), title, text, strategy, None, None)


def _allowed(sites: DataFrame, blocked: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Sites that the policy lets through, and rows of PAGE for the others."""
    judged = sites.select("site").withColumn("reason", scrape_reason(F.col("site"), blocked))
    refused = judged.where("reason <> 'allowed'")
    columns = {"site": F.col("site"), "url": F.col("site"), "error_type": F.lit("PolicyBlocked"), "error_category": F.col("reason")}
    kinds = dict(c.split() for c in PAGE.split(", "))
    return judged.where("reason = 'allowed'").select("site"), refused.select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def _each(sites: DataFrame, run: Callable[[str], Iterator[tuple]], strategy: str, failed: str) -> DataFrame:
    """Rows of PAGE of each site, a domain's sites in one task."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for site in batch["site"]:
                try:
                    rows += run(site)
                except Exception as e:  # noqa: BLE001 - a site that fails is a row
                    rows.append((site, site, None, None, None, strategy, type(e).__name__, failed))
            yield pd.DataFrame(rows, columns=_NAMES).astype({"status_code": "Int32"})

    return sites.repartition(domain(F.col("site"))).mapInPandas(go, PAGE)


def scraped(sites: DataFrame, scrape: Callable[[str], Mapping], blocked: tuple[str, ...] = ()) -> DataFrame:
    """One page a site from a scraping service. Its answer is a document, or holds it (or a list of them) under `data`; the first
    text that is not empty counts."""

    def one(site: str) -> Iterator[tuple]:
        answer = scrape(site)
        data = answer.get("data")
        document = data if isinstance(data, Mapping) else data[0] if isinstance(data, list) and data else answer
        about = document.get("metadata") if isinstance(document.get("metadata"), Mapping) else {}
        yield _page(site, document, SERVICE_TEXTS, "service_extraction", "service_empty_content", about)

    able, refused = _allowed(sites, blocked)
    return _normal(_each(able, one, "service_extraction", "service_failed").unionByName(refused))


def crawled(sites: DataFrame, crawl: Callable[[str, int, int], Iterator[Mapping]], max_pages: int = 5, max_depth: int = 1, blocked: tuple[str, ...] = ()) -> DataFrame:
    """At most max_pages items of a crawler for each site; the crawler is told both limits and keeps to the site's domain."""

    def items(site: str) -> Iterator[tuple]:
        for n, item in enumerate(crawl(site, max_pages, max_depth)):
            if n >= max_pages:
                break
            yield _page(site, item, CRAWL_TEXTS, "structured_crawl", "crawl_empty_content")

    able, refused = _allowed(sites, blocked)
    found = _each(able, lambda site: list(items(site)), "structured_crawl", "crawl_failed")
    at_home = F.col("error_type").isNotNull() | (domain(F.col("url")) == domain(F.col("site")))
    return _normal(found.where(at_home).unionByName(refused))


def _normal(pages: DataFrame) -> DataFrame:
    return pages.withColumn("url", normalize_url(F.col("url")))


def browser(url: str, timeout: float = 30.0) -> tuple[str, int, str]:
    """Final URL, status and HTML of a page after its scripts have run; a `get` for connectors.fetch. Needs a browser library."""
    start = optional("playwright.sync_api", "sync_playwright")
    if start is None:
        raise RuntimeError("install playwright and a browser to render pages")
    with start() as p:
        window = p.chromium.launch()
        try:
            page = window.new_page()
            answer = page.goto(url, timeout=timeout * 1000, wait_until="networkidle")
            return page.url, answer.status if answer else 0, page.content()
        finally:
            window.close()


Extractor = Callable[[str], tuple[str, str, list[str]]]


def soup(html: str) -> tuple[str, str, list[str]]:
    """Title, text and links by a tolerant parser, if one is installed; else nothing."""
    make = optional("bs4", "BeautifulSoup")
    if make is None:
        return "", "", []
    tree = make(html, "html.parser")
    title = tree.find("title")
    return (title.get_text(" ", strip=True) if title else ""), tree.get_text(" ", strip=True), [a["href"] for a in tree.find_all("a") if a.get("href")]


def article(html: str) -> tuple[str, str, list[str]]:
    """The main text by a library for articles, if one is installed; it gives neither title nor links."""
    extract = optional("trafilatura", "extract")
    return "", (extract(html) or "") if extract else "", []


def extract_best(pages: DataFrame, extractors: dict[str, Extractor] | None = None, fallback: str = "stdlib_html") -> DataFrame:
    """Pages (url, html, ...) with title, main_text and links, each from the first extractor that has it, the standard parser last;
    and strategy: the names of the extractors whose text or links were used, or the fallback's."""
    chain = extractors if extractors is not None else {"article": article, "soup": soup}
    kept = [f for f in pages.schema.fields if f.name != "html"]

    def tried(extract: Extractor, html: str) -> tuple[str, str, list[str]]:
        try:
            return extract(html)
        except Exception:  # noqa: BLE001 - an extractor that fails has nothing to say
            return "", "", []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for html in batch["html"]:
                html = html or ""
                found = {name: tried(e, html) for name, e in chain.items()}
                found[fallback] = read_html(html)
                title, text, links = (next((f[i] for f in found.values() if f[i] and f[i] != UNKNOWN), None) for i in range(3))
                used = [n for n, f in found.items() if n != fallback and any(f)]
                text = " ".join(text.split()) if text else UNKNOWN
                marked = any(m in html.lower() for m in SHELL_MARKS)
                short = text == UNKNOWN or len(text) < LOW_TEXT
                rows.append((" ".join(title.split()) if title else UNKNOWN, text, list(links or []), "+".join(used) or fallback, marked and short))
            out = pd.DataFrame(rows, columns=["title", "main_text", "links", "strategy", "needs_js"])
            yield pd.concat([batch[[f.name for f in kept]].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.mapInPandas(run, f"{kinds}, title string, main_text string, links array<string>, strategy string, needs_js boolean")


def collect(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """key, url, main_text, error_type, error_category: what was collected for each candidate (key, primary_url) from pages (site,
    url, main_text, error_type, error_category); a candidate without a site is an error of its own."""
    lost = candidates.where(F.coalesce(F.col("primary_url"), F.lit(UNKNOWN)) == UNKNOWN).select(
        "key", F.lit(UNKNOWN).alias("url"), F.lit(None).cast("string").alias("main_text"),
        F.lit("MissingPrimaryUrl").alias("error_type"), F.lit("missing_primary_url").alias("error_category"),
    )
    at = candidates.where(F.col("primary_url") != UNKNOWN).select("key", F.col("primary_url").alias("site"))
    return at.join(pages, "site").select("key", "url", "main_text", "error_type", "error_category").unionByName(lost)


