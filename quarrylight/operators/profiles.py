"""Profiles from page texts, evidence by field with conflicts, and the quality of a collection run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import UNKNOWN, collapse, fold, origin, ratio, snippet, strip

# Labels that introduce a field's value, in order of trial.
LABELS = {
    "company_summary": ("resumo", "summary", "sobre", "about"),
    "sector": ("setor", "sector"),
    "product": ("produto", "product", "solucao", "solution"),
    "customers": ("clientes", "customers"),
    "funding": ("funding", "investimento", "rodada"),
    "founders": ("founders", "fundadores", "fundador", "fundadora"),
    "technologies_used": ("tecnologias", "technologies", "stack"),
    "ai_signals": ("sinais de ia", "ai signals", "ia", "ai"),
    "location": ("localizacao", "localização", "location", "sede"),
}
# Words that tell a sector, and words that tell of AI, in order of trial.
SECTOR_WORDS = {
    "healthtech": "healthtech", "fintech": "fintech", "cybersecurity": "cybersecurity", "ciberseguranca": "cybersecurity",
    "industria": "industry", "industrial": "industry", "dados": "data", "data": "data",
}
AI_WORDS = (
    "agente de ia", "agentes de ia", "ai-native", "computer vision", "ia generativa", "inteligencia artificial",
    "machine learning", "modelo de ia", "modelos de ia", "visao computacional",
)
FIELDS = ("company_name", "official_site", *LABELS)
# Fields a profile needs, and when a run is ready to be assessed.
REQUIRED = ("company_name", "official_site", "company_summary", "sector", "product", "ai_signals")
EVIDENCE = "struct<url:string,title:string,snippet:string,collected_at:string,source_type:string>"
READY = {"candidates": 1, "official_site_rate": 0.7, "complete_profile_rate": 0.6, "average_evidences": 3.0}


def labelled_pairs(text: Column, labels: tuple[str, ...]) -> Column:
    """array<struct<label, value>>: what follows "label:" at the start of a sentence or line, all labels in one pass."""
    pattern = F.lit(rf"(?iu)(?:^|[.;\n])\s*({'|'.join(map(re.escape, labels))})\s*:\s*([^.;\n]+)")
    group = lambda k: F.regexp_extract_all(text, pattern, F.lit(k))
    pairs = F.arrays_zip(F.transform(group(1), F.lower).alias("label"), F.transform(group(2), strip).alias("value"))
    return F.when(F.contains(text, F.lit(":")), pairs)


def first_value(pairs: Column, labels: tuple[str, ...]) -> Column:
    """The first value of the first label that has one; null if none has."""
    of = lambda label: F.get(F.filter(pairs, lambda p: (p["label"] == label.lower()) & (p["value"] != "")), F.lit(0))["value"]
    return F.coalesce(*[of(x) for x in labels])


def profile_fields(pages: DataFrame, labels: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """key, field, value, claim_source, evidences: the fields of each profile key, one row a field.

    pages: key, pos, url, title, main_text, collected_at, and name (what to call the company if no title does).
    A field is observed where a label or title gives it, inferred where words of the text do, else unknown. Each text is read
    once; past that, rows are what was found, not texts.
    """
    labels = labels or LABELS
    text = F.when(F.col("main_text") != UNKNOWN, F.col("main_text"))
    every_label = tuple(x for words in labels.values() for x in words)
    read = pages.select(
        "key", "pos", "url", "title", "main_text", "collected_at",
        fold(F.coalesce("main_text", F.lit(""))).alias("plain"), labelled_pairs(text, every_label).alias("pairs"),
    )
    claim = lambda f, v, word, order, observed: F.when(
        v.isNotNull(), F.struct(F.lit(f).alias("field"), v.alias("value"), word.alias("word"), F.lit(order).alias("order"), F.lit(observed).alias("observed"))
    )
    title = F.nullif(strip(F.regexp_extract("title", r"^(.*?)(?:\s+[|-]\s+.*)?$", 1)), F.lit(""))
    name, site = F.when(F.col("title") != UNKNOWN, title), origin(F.col("url"))
    said = [claim("company_name", name, name, 0, True), claim("official_site", site, site, 0, True)]
    said += [claim(f, v := first_value(F.col("pairs"), words), v, 0, True) for f, words in labels.items()]
    told = lambda word, value: F.when(F.contains("plain", F.lit(word)), F.lit(value))
    said += [claim("sector", told(w, sector), F.lit(w), i, False) for i, (w, sector) in enumerate(SECTOR_WORDS.items())]
    said += [claim("ai_signals", told(w, w), F.lit(w), i, False) for i, w in enumerate(AI_WORDS)]
    claims = read.withColumn("c", F.explode(F.array_compact(F.array(*said)))).select(
        "key", "pos", "c.field", "c.value", "c.order", "c.observed",
        F.struct("url", "title", snippet(F.col("main_text"), F.col("c.word"), folded=F.col("plain")).alias("snippet"), "collected_at", F.lit("collected_page").alias("source_type")).alias("e"),
    )
    guess = F.collect_list(F.when(~F.col("observed"), F.struct("pos", "order", "value", "e")))
    found = claims.groupBy("key", "field").agg(
        F.min(F.when(F.col("observed"), F.struct("pos", "value", "e"))).alias("o"), F.array_sort(guess).alias("guesses")
    )
    profile = pages.groupBy("key").agg(F.max("name").alias("name")).withColumn("field", F.explode(F.array(*map(F.lit, ("company_name", "official_site", *labels)))))
    joined = profile.join(found, ["key", "field"], "left")
    words = F.array_distinct(F.transform("guesses", lambda g: g["value"]))
    one = lambda v: F.get(F.filter("guesses", lambda g: g["value"] == v), F.lit(0))["e"]
    first = F.get("guesses", F.lit(0))
    none = F.array().cast(f"array<{EVIDENCE}>")
    row = lambda v, source, es: F.struct(v.alias("value"), F.lit(source).alias("claim_source"), es.alias("evidences"))
    out = (
        F.when(F.col("o").isNotNull() & (F.col("o.value") != UNKNOWN), row(F.col("o.value"), "observed", F.array("o.e")))
        .when((F.col("field") == "company_name") & (F.coalesce("name", F.lit(UNKNOWN)) != UNKNOWN), row(F.col("name"), "inferred", none))
        .when((F.col("field") == "ai_signals") & (F.size("guesses") > 0), row(F.array_join(words, ", "), "inferred", F.transform(words, one)))
        .when((F.col("field") == "sector") & (F.size("guesses") > 0), row(first["value"], "inferred", F.array(first["e"])))
        .otherwise(row(F.lit(UNKNOWN), UNKNOWN, none))
    )
    return joined.select("key", "field", out.alias("x")).select("key", "field", "x.*")


def evidence_groups(claims: DataFrame) -> DataFrame:
    """key, field, value, values, has_conflict: claims (key, field, pos, value, evidences) that are known and sourced.

    The first claim's value stands; values that differ beyond case, accents and spaces conflict.
    """
    held = claims.where((F.col("value") != UNKNOWN) & (F.size("evidences") > 0)).withColumn("norm", collapse(fold(F.col("value"))))
    values = held.groupBy("key", "field", "norm").agg(F.min(F.struct("pos", "value")).alias("v"))
    grouped = values.groupBy("key", "field").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    texts = F.transform("vs", lambda v: v["value"])
    return grouped.select("key", "field", F.get(texts, F.lit(0)).alias("value"), texts.alias("values"), (F.size("vs") > 1).alias("has_conflict"))


def evidences_of(claims: DataFrame) -> DataFrame:
    """key, field, evidence, n: distinct evidences in order of their first place, each with its last value."""
    each = claims.select("key", "field", F.col("pos").alias("claim"), F.posexplode("evidences").alias("k", "e"))
    place = F.struct("claim", "k")
    one = each.groupBy("key", "field", "e.url", "e.snippet", "e.source_type").agg(F.min(place).alias("first"), F.max_by("e", place).alias("evidence"))
    order = Window.partitionBy("key", "field").orderBy("first")
    return one.select("key", "field", "evidence", F.row_number().over(order).alias("n"))


def unknown_fields(fields: DataFrame) -> DataFrame:
    """field, n, rank: how many profiles do not know a field, most first."""
    counted = fields.where(F.col("value") == UNKNOWN).groupBy("field").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "field")))  # as many rows as fields


def collection_quality(candidates: DataFrame | int, fields: DataFrame) -> DataFrame:
    """One row: counts, rates at two places and whether the run is ready, with the reasons if not. candidates: how many, or a
    row of that number."""
    per = fields.groupBy("key").agg(
        F.bool_and(F.when(F.col("field").isin(*REQUIRED), F.col("value") != UNKNOWN)).alias("complete"),
        F.bool_or((F.col("field") == "official_site") & (F.col("value") != UNKNOWN)).alias("site"),
        F.sum(F.size("evidences")).alias("evidences"),
    )
    total = per.agg(
        F.count("*").alias("profiles"),
        F.count_if("site").alias("official_sites"),
        F.count_if("complete").alias("complete_profiles"),
        F.coalesce(F.sum("evidences"), F.lit(0)).alias("evidences"),
    )
    if isinstance(candidates, int):
        total = total.withColumn("candidates", F.lit(candidates).cast("bigint"))
    else:
        total = total.crossJoin(F.broadcast(candidates.toDF("candidates")))  # one row each
    total = (
        total.withColumn("official_site_rate", F.bround(ratio(F.col("official_sites"), F.col("candidates")), 2))
        .withColumn("complete_profile_rate", F.bround(ratio(F.col("complete_profiles"), F.col("candidates")), 2))
        .withColumn("average_evidences", F.bround(ratio(F.col("evidences"), F.col("profiles")), 2))
    )
    names = {"candidates": "not_enough_candidates", "official_site_rate": "official_site_coverage_below_threshold", "complete_profile_rate": "minimum_profile_coverage_below_threshold", "average_evidences": "average_evidence_below_threshold"}
    reasons = F.array_compact(F.array(*[F.when(F.col(k) < v, names[k]) for k, v in READY.items()]))
    return total.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0)


def source_success(pages: DataFrame, by: str = "source") -> DataFrame:
    """Attempts, successes and their rate by source (pages: source, is_error)."""
    counted = pages.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if(~F.col("is_error")).alias("successes"))
    return counted.withColumn("success_rate", ratio(F.col("successes"), F.col("attempts")))


def strategy_quality(pages: DataFrame, low_text: int = 80) -> DataFrame:
    """By strategy: attempts, errors, unknown and low texts, mean length, extraction strategies (pages: strategy, main_text,
    is_error, extraction)."""
    length = F.when(F.col("main_text") == UNKNOWN, 0).otherwise(F.char_length("main_text"))
    good = ~F.col("is_error")
    counted = pages.groupBy("strategy").agg(
        F.count("*").alias("attempts"),
        F.count_if("is_error").alias("errors"),
        F.count_if(good & (F.col("main_text") == UNKNOWN)).alias("unknown_texts"),
        F.count_if(good & (length < low_text)).alias("low_texts"),
        F.coalesce(F.sum(F.when(good, length)), F.lit(0)).alias("characters"),
        F.array_sort(F.collect_set(F.when(good, F.col("extraction")))).alias("extractions"),
    )
    got = F.col("attempts") - F.col("errors")
    return counted.select(
        "*",
        ratio(F.col("errors"), F.col("attempts")).alias("failure_rate"),
        ratio(F.col("unknown_texts"), got).alias("unknown_rate"),
        ratio(F.col("low_texts"), got).alias("low_rate"),
        ratio(F.col("characters"), got).alias("average_length"),
    )


def with_records(profiles: DataFrame, groups: DataFrame, assessments: DataFrame) -> DataFrame:
    """Profiles (key, company_name, ...) with their evidence groups (key, field, value, has_conflict) as a list in order of fields, and
    the assessment (company_name, pos, classification) of their company's name: of several with one name the last counts."""
    held = groups.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value", "has_conflict"))).alias("groups"))
    last = assessments.groupBy("company_name").agg(F.max_by("classification", "pos").alias("classification"))
    return profiles.join(held, "key", "left").join(last, "company_name", "left")
