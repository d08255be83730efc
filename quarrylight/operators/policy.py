"""Rules about URLs and sources, as data: classification, scrape policy, robots, error categories, official sources."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import UNKNOWN, domain, fold, url_netloc, url_path

# Domains of directories, news and personal profiles.
DIRECTORY_DOMAINS = (
    "100openstartups.net", "abstartups.com.br", "acestartups.com.br", "anjosdobrasil.net", "bossainvest.com",
    "cubo.network", "darwinstartups.com", "distrito.me", "endeavor.org.br", "inovativabrasil.com.br", "latitud.com",
    "liga.ventures", "openstartups.net", "startse.com", "wow.ac",
)
NEWS_DOMAINS = (
    "braziljournal.com", "exame.com", "globo.com", "meioemensagem.com.br", "mobiletime.com.br", "neofeed.com.br",
    "startups.com.br", "valor.globo.com",
)
PERSONAL_DOMAINS = ("linkedin.com", "twitter.com", "x.com")
# Path segments of pages behind a login.
LOGIN_SEGMENTS = ("auth", "entrar", "login", "log-in", "signin", "sign-in")
# Confidence in a candidate by the type of its source.
SOURCE_SCORES = {"company": 0.9, "directory": 0.75, "news": 0.65, "personal_profile": 0.45, UNKNOWN: 0.2}
# HTTP codes of pages that refuse, and of pages that are not there.
BLOCKED_CODES, UNAVAILABLE_CODES = (401, 403, 429), (404, 410, 500, 502, 503, 504)


def source_type(url: Column) -> Column:
    at = domain(url)
    return (
        F.when(at.isin(*PERSONAL_DOMAINS) | F.contains(F.lower(url_path(url)), F.lit("/in/")), "personal_profile")
        .when(at.isin(*DIRECTORY_DOMAINS), "directory")
        .when(at.isin(*NEWS_DOMAINS), "news")
        .when(at != UNKNOWN, "company")
        .otherwise(UNKNOWN)
    )


def source_score(kind: Column, evidences: Column) -> Column:
    """Base score of the source type, 0.05 more for each further evidence, 0.98 at most."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_SCORES.items() for x in kv])[kind], F.lit(SOURCE_SCORES[UNKNOWN]))
    return F.bround(F.least(base + F.greatest(evidences - 1, F.lit(0)) * 0.05, F.lit(0.98)), 2)


def needs_login(url: Column) -> Column:
    segments = F.transform(F.split(F.lower(url_path(url)), "/"), lambda s: F.replace(s, F.lit("_"), F.lit("-")))
    return F.arrays_overlap(segments, F.array(*map(F.lit, LOGIN_SEGMENTS)))


def scrape_reason(url: Column, blocked: tuple[str, ...] = ()) -> Column:
    at = domain(url)
    return F.when(at.isin(*blocked) if blocked else F.lit(False), "blocked_domain").when(needs_login(url), "login_required").otherwise("allowed")


def error_category(code: Column, kind: Column) -> Column:
    """kind: timeout, http, url or anything else."""
    http = F.when(code.isin(*BLOCKED_CODES), "blocked").when(code.isin(*UNAVAILABLE_CODES), "unavailable").otherwise("network_error")
    return F.when(kind == "timeout", "timeout").when(kind == "http", http).when(kind == "url", "network_error").otherwise(UNKNOWN)


@dataclass(frozen=True)
class OfficialSources:
    """Which sources count as official: hosts with all below them, (host, path prefix) pairs, whole URLs, and types."""

    hosts: tuple[str, ...]
    prefixes: tuple[tuple[str, str], ...] = ()
    urls: tuple[str, ...] = ()
    types: tuple[str, ...] = ()

    def accepts(self, url: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^.*@|:\d*$", "")
        found = F.lit(False)
        for h in self.hosts:
            found = found | (host == h) | host.endswith(f".{h}")
        for h, p in self.prefixes:
            found = found | ((host == h) & url_path(url).startswith(p))
        return F.coalesce(found | (url.isin(*self.urls) if self.urls else F.lit(False)), F.lit(False))

    def issue(self, url: Column, kind: Column) -> Column:
        """The first reason against a document's source; null if there is none."""
        return (
            F.when(F.coalesce(url, F.lit("")) == "", "missing_source_url")
            .when(~self.accepts(url), "source_url_not_official")
            .when(~kind.isin(*self.types) if self.types else F.lit(False), "unsupported_source_type")
        )


def robots_decisions(urls: DataFrame, robots: DataFrame, agent: str = "*", conservative: bool = True) -> DataFrame:
    """url, allowed, reason, crawl_delay by the rules of each origin. robots: origin, body (null: could not be read).

    One row of rules an origin; rules are parsed where the URLs are, each origin once a batch.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.robotparser import RobotFileParser

        for batch in batches:
            out = []
            for body, group in batch.groupby(batch["body"].fillna("\x01"), sort=False):
                if body == "\x01":  # could not be read
                    out += [(u, not conservative, "robots_unavailable" if conservative else "allowed", None) for u in group["url"]]
                    continue
                rules = RobotFileParser()
                rules.parse(body.splitlines())
                delay = rules.crawl_delay(agent)
                for u in group["url"]:
                    ok = rules.can_fetch(agent, u)
                    out.append((u, ok, "allowed" if ok else "robots_disallowed", float(delay) if delay is not None else None))
            yield pd.DataFrame(out, columns=["url", "allowed", "reason", "crawl_delay"])

    from quarrylight.functions.text import origin

    joined = urls.select("url", origin(F.col("url")).alias("origin")).join(robots, "origin", "left").select("url", "body")
    return joined.mapInPandas(judge, "url string, allowed boolean, reason string, crawl_delay double")


def collection_decision(policy: Column, robots_allowed: Column, robots_reason: Column, limit: Column, delay: Column) -> Column:
    """struct(allowed, reason, delay): policy first, then robots; the delay is the larger of both."""
    reason = F.when(policy != "allowed", policy).when(~robots_allowed, robots_reason).otherwise("allowed")
    wait = F.when(reason == "allowed", F.greatest(limit, F.coalesce(delay, F.lit(0.0)))).otherwise(F.lit(0.0))
    return F.struct((reason == "allowed").alias("allowed"), reason.alias("reason"), wait.alias("delay"))


def company_name_matches(name: Column, domain_name: Column) -> Column:
    """Whether normalised names agree: equal or a longer form, with or without their spaces."""
    short = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    agree = (name == domain_name) | name.startswith(F.concat(domain_name, F.lit(" "))) | short(name).startswith(short(domain_name))
    return F.when((name == UNKNOWN) | (domain_name == UNKNOWN), False).otherwise(agree)


# Titles of articles and lists rather than names.
LIST_TITLES = (
    r"^\d+\b", r"\b\d+\s+startups?\b", r"\bstartups?\s+(?:brasileiras?|de ia|para acompanhar|promissoras?)\b",
    r"\b(?:lista|ranking|melhores|conheca|top)\b", r"\bpara acompanhar\b",
)


def plausible_name(name: Column) -> Column:
    plain = fold(name)
    return (name != UNKNOWN) & ~plain.rlike("|".join(LIST_TITLES)) & (F.size(F.split(plain, r"\s+")) <= 7)
