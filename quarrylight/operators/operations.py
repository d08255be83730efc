"""How runs went: roll-ups of checks, reports on collection, figures that a front end shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.secrets import leaks, redact
from quarrylight.functions.text import UNKNOWN, ratio
from quarrylight.operators.pages import LOW_TEXT


def roll_up(steps: DataFrame, *by: str) -> DataFrame:
    """by, status, passed, failed, skipped over steps (status): one failure fails, else one pass passes, else it was skipped."""
    n = steps.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")])
    return n.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("passed") > 0, "passed").otherwise("skipped"))


def check_matrix(integrations: DataFrame, settings: DataFrame, results: DataFrame, secrets: tuple[str, ...] = ()) -> DataFrame:
    """integration, status, reason, message, leaked: each integration (integration, flag, required settings) as skipped where its flag
    is not set, failed where a setting it needs is missing or its result leaks a secret, else as its result (integration, status,
    message) says. settings: name, value. Messages are redacted."""
    on = settings.where(F.coalesce(F.trim("value"), F.lit("")) != "").agg(F.collect_set("name").alias("set"))  # one row
    found = integrations.crossJoin(F.broadcast(on)).join(results, "integration", "left")
    leaked = leaks(results, "integration", ("message",), secrets).select("integration", F.lit(True).alias("leaked")).distinct()
    found = found.join(leaked, "integration", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))
    missing = F.array_except("required", "set")
    state = (
        F.when(~F.array_contains("set", F.col("flag")), F.struct(F.lit("skipped").alias("status"), F.lit("flag_not_set").alias("reason")))
        .when(F.size(missing) > 0, F.struct(F.lit("failed").alias("status"), F.concat(F.lit("missing:"), F.array_join(F.array_sort(missing), ",")).alias("reason")))
        .when(F.col("leaked"), F.struct(F.lit("failed").alias("status"), F.lit("credential_leak").alias("reason")))
        .when(F.col("status").isNull(), F.struct(F.lit("skipped").alias("status"), F.lit("no_result").alias("reason")))
        .otherwise(F.struct("status", F.lit("result").alias("reason")))
    )
    return found.select("integration", state.alias("x"), redact(F.col("message"), secrets).alias("message"), "leaked").select("integration", "x.*", "message", "leaked")


def page_figures(pages: DataFrame, *by: str, low_text: int = LOW_TEXT) -> DataFrame:
    """Pages, errors, pages with little text, and the extraction strategies in order (pages: main_text, is_error, strategy)."""
    good = ~F.col("is_error")
    length = F.when(F.col("main_text") == UNKNOWN, 0).otherwise(F.char_length("main_text"))
    return pages.groupBy(*by).agg(
        F.count_if(good).alias("pages"), F.count_if("is_error").alias("errors"), F.count_if(good & (length < low_text)).alias("low_texts"),
        F.array_sort(F.collect_set(F.when(good, F.nullif("strategy", F.lit(""))))).alias("strategies"),
    )


def field_figures(fields: DataFrame, *by: str) -> DataFrame:
    """Fields of profiles (value, claim_source), how many are unknown, their share, and the share that is known."""
    lost = (F.col("value") == UNKNOWN) | (F.col("claim_source") == UNKNOWN)
    n = fields.groupBy(*by).agg(F.count("*").alias("fields"), F.count_if(lost).alias("unknown"))
    rate = ratio(F.col("unknown"), F.col("fields"))
    return n.withColumn("unknown_rate", rate).withColumn("completeness", F.when(F.col("fields") > 0, 1 - rate).otherwise(0.0))


def profile_figures(fields: DataFrame, groups: DataFrame, key: str = "key") -> DataFrame:
    """key, fields, unknown, unknown_rate, completeness, conflicts: a profile's figures; groups: key, field, has_conflict."""
    conflicts = groups.groupBy(key).agg(F.count_if("has_conflict").alias("conflicts"))
    return field_figures(fields, key).join(conflicts, key, "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


def first_by(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Each key's first row."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("_n = 1").drop("_n")


def scraping_report(sites: DataFrame, pages: DataFrame, fields: DataFrame, low_text: int = LOW_TEXT) -> DataFrame:
    """One row a site (site, policy_reason, robots_reason): its pages, errors, low texts and their URLs, how complete its profile is,
    and whether it went well (pages: site, url, main_text, is_error, strategy; fields: site, value, claim_source)."""
    seen = page_figures(pages, "site", low_text=low_text)
    length = F.when(F.col("main_text") == UNKNOWN, 0).otherwise(F.char_length("main_text"))
    short = pages.where(~F.col("is_error") & (length < low_text)).groupBy("site").agg(F.array_sort(F.collect_set("url")).alias("low_urls"))
    joined = sites.join(seen, "site", "left").join(short, "site", "left").join(field_figures(fields, "site").select("site", "completeness"), "site", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pages", "errors", "low_texts")} | {"completeness": F.coalesce("completeness", F.lit(0.0))}
    filled = joined.withColumns(zero | {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("strategies", "low_urls")})
    verdict = F.when(F.col("policy_reason") != "allowed", F.col("policy_reason")).when(F.col("robots_reason") != "allowed", F.col("robots_reason"))
    return filled.withColumn("verdict", verdict.when(F.col("pages") == 0, "no_pages").when(F.col("low_texts") == F.col("pages"), "low_text_only").otherwise("collected"))
