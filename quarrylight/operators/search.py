"""Search: parsing a request, planning terms, normalising responses, and a budget over planned results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import UNKNOWN, collapse, fold, known

RESPONSE = "web struct<results:array<struct<title:string,url:string,description:string,snippet:string>>>"
# Themes and stages by their aliases, in order of trial.
THEMES = {
    "agentes": "agents", "agents": "agents", "ai-native": "ai_native", "cybersecurity": "cybersecurity",
    "ciberseguranca": "cybersecurity", "computer vision": "computer_vision", "dados": "data", "data": "data",
    "fintech": "fintech", "healthtech": "healthtech", "ia generativa": "generative_ai", "generative ai": "generative_ai",
    "industria": "industry", "robotics": "robotics", "robotica": "robotics", "voz": "voice",
}
STAGES = {"early stage": "early_stage", "growth": "growth", "scale up": "scale_up", "scale-up": "scale_up"}


def first_alias(text: Column, aliases: dict[str, str]) -> Column:
    """The meaning of the first alias that stands in the folded text as whole words."""
    plain = fold(text)
    found = [F.when(plain.rlike(rf"(?<!\w){alias}(?!\w)"), meaning) for alias, meaning in aliases.items()]
    return F.coalesce(*found, F.lit(UNKNOWN))


# The theme of a query that only says "AI", and the results that are asked for without a limit.
BARE_THEMES = {"ia": "artificial_intelligence", "ai": "artificial_intelligence"}
DEFAULT_LIMIT = 10


def result_limit(limit: Column) -> Column:
    """The limit of a request: ten if it has none; one below 1 fails."""
    wrong = F.raise_error(F.lit("limit must be greater than zero")).cast("int")
    return F.when(limit.isNull(), DEFAULT_LIMIT).when(limit < 1, wrong).otherwise(limit.cast("int"))


# Words that say of what kind the place after them is, and words that may stand between.
CITY_QUALIFIERS = ("cidade", "municipio")
STATE_QUALIFIERS = ("estado", "uf")
LOCATION_PREPOSITIONS = ("de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas")
#: Kinds of places in order of trial; a place that its qualifier names comes before all others.
PLACES = ("city", "state", "state_code", "macro_region", "country")
#: Words of a place's name at most.
PLACE_WORDS = 6


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[^\w]+"), lambda w: w != "")


def place_of(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """query_id, region, region_type: the place that a query names, by kind in the order of trial, then by priority.

    regions: alias (folded), region, region_type (PLACES), priority. A query's runs of words meet the aliases by equality, so a dimension
    of any size is no loop; what meets is held against the folded text: whole words, and for cities and states whether "city
    of", "state of" stand before.
    """
    plain = queries.select("query_id", fold(collapse(F.col("query"))).alias("plain")).withColumn("ws", _words(F.col("plain")))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PLACE_WORDS)), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size("ws"), F.lit(1))), lambda i: i + n - 1 <= F.size("ws")), lambda i: F.array_join(F.slice("ws", i, n), " "))))
    said = plain.select("query_id", "plain", F.explode(F.array_distinct(runs)).alias("run"))
    named = regions.select("alias", "region", "region_type", "priority", F.array_join(_words(F.col("alias")), " ").alias("run"))
    literal = F.concat(F.lit(r"\Q"), "alias", F.lit(r"\E"))
    whole = F.concat(F.lit(r"(?U)\b"), literal, F.lit(r"\b"))
    between = rf"\s+(?:{'|'.join(LOCATION_PREPOSITIONS)})?\s*"
    before = F.when(F.col("region_type") == "city", "|".join(CITY_QUALIFIERS)).when(F.col("region_type").isin("state", "state_code"), "|".join(STATE_QUALIFIERS))
    qualified = F.coalesce(F.regexp_like("plain", F.concat(F.lit(r"(?U)\b(?:"), before, F.lit(rf"){between}"), literal, F.lit(r"\b"))), F.lit(False))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, PLACES)), F.col("region_type")), F.lit(0)).cast("int")
    rank = F.struct(F.when(qualified, kind).otherwise(kind + len(PLACES)).alias("tier"), "priority", "alias")
    hits = said.join(named, "run").where(F.regexp_like("plain", whole)).select("query_id", F.struct("region", "region_type").alias("r"), rank.alias("rank"))
    best = hits.groupBy("query_id").agg(F.min_by("r", "rank").alias("r"))
    return best.select("query_id", "r.region", F.when(F.col("r.region_type") == "state_code", "state").otherwise(F.col("r.region_type")).alias("region_type"))


def parse_queries(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """query_id, query with region, region_type (see `place_of`), theme, stage and limit (queries may have a column limit)."""
    limit = F.col("limit") if "limit" in queries.columns else F.lit(None).cast("int")
    return queries.join(place_of(queries, regions), "query_id", "left").select(
        "query_id",
        collapse(F.col("query")).alias("query"),
        F.coalesce("region", F.lit(UNKNOWN)).alias("region"),
        F.coalesce("region_type", F.lit(UNKNOWN)).alias("region_type"),
        first_alias(F.col("query"), THEMES | BARE_THEMES).alias("theme"),
        first_alias(F.col("query"), STAGES).alias("stage"),
        result_limit(limit).alias("limit"),
    )


def plan(params: DataFrame, sources: DataFrame) -> DataFrame:
    """run_id, term, target_source, scope, priority: two broad terms, then one a source (with its site if it has a domain).

    params: run_id, term, english_term. sources: name, domain, pos. A term and source come once, first wins.
    """
    broad = params.select("run_id", F.posexplode(F.array("term", "english_term")).alias("p", "term"), F.lit("web").alias("target_source"), F.lit("broad_web").alias("scope"))
    site = F.when(F.col("domain").isNotNull(), F.concat(F.lit("site:"), "domain", F.lit(" "), "term")).otherwise(F.concat("term", F.lit(" "), "name"))
    specific = params.crossJoin(F.broadcast(sources)).select("run_id", (F.col("pos") + 2).alias("p"), site.alias("term"), F.col("name").alias("target_source"), F.lit("specific_source").alias("scope"))
    rows = broad.unionByName(specific)
    once = Window.partitionBy("run_id", F.lower("term"), F.lower("target_source")).orderBy("p")
    kept = rows.withColumn("n", F.row_number().over(once)).where("n = 1")
    return kept.select("run_id", "term", "target_source", "scope", F.row_number().over(Window.partitionBy("run_id").orderBy("p")).alias("priority"))


def response_results(responses: DataFrame, limit: int) -> DataFrame:
    """Results of raw JSON responses (run_id, term, body), numbered from 1, what is missing as unknown."""
    found = responses.select("run_id", "term", F.posexplode(F.slice(F.from_json("body", RESPONSE)["web"]["results"], 1, limit)).alias("p", "r"))
    text = F.coalesce(F.nullif(F.col("r.description"), F.lit("")), F.col("r.snippet"))
    return found.select("run_id", "term", (F.col("p") + 1).alias("position"), known(F.col("r.title")).alias("title"), known(F.col("r.url")).alias("url"), known(text).alias("snippet"))


def budgeted(results: DataFrame, per_term: int, total: int) -> DataFrame:
    """The results a budget leaves: per_term of each plan item at most, in order of priority, one place kept for each later
    item. results: run_id, priority, items (of the plan), position."""
    held = results.where(F.col("position") <= per_term)
    sizes = held.groupBy("run_id", "priority").agg(F.count("*").alias("n"), F.max("items").alias("items"))
    items = sizes.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("priority", "n", "items"))).alias("xs"))  # a plan is short

    def take(acc: Column, x: Column) -> Column:
        left, later = F.lit(total) - acc["used"], x["items"] - x["priority"]
        now = F.greatest(left - F.least(later, F.greatest(left - 1, F.lit(0))), F.lit(1))  # while anything is left, one at least
        return F.when(left > 0, F.least(x["n"], now)).otherwise(F.lit(0).cast("bigint"))

    step = lambda acc, x: F.struct((acc["used"] + take(acc, x)).alias("used"), F.concat(acc["takes"], F.array(take(acc, x))).alias("takes"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("takes"))
    typed = F.transform("xs", lambda x: F.struct(x["priority"].cast("bigint").alias("priority"), x["n"].cast("bigint").alias("n"), x["items"].cast("bigint").alias("items")))
    takes = items.select("run_id", typed.alias("xs"), F.aggregate(typed, start, step)["takes"].alias("takes"))
    allowed = takes.select("run_id", F.explode(F.arrays_zip("xs", "takes")).alias("z")).select("run_id", F.col("z.xs.priority").alias("priority"), F.col("z.takes").alias("take"))
    order = Window.partitionBy("run_id", "priority").orderBy("position")
    joined = held.join(allowed, ["run_id", "priority"]).withColumn("nth", F.row_number().over(order))
    return joined.where("nth <= take").drop("take", "nth")


def traced(results: DataFrame) -> DataFrame:
    """Results (term, target_source, position, snippet, ...) whose snippets say where they come from."""
    mark = F.concat(F.lit(" [search_term="), "term", F.lit("; source="), "target_source", F.lit("; position="), F.col("position").cast("string"), F.lit("]"))
    return results.withColumn("snippet", F.concat("snippet", mark))


def search_errors(plan_items: DataFrame, answers: DataFrame) -> DataFrame:
    """run_id, term, target_source, error_type, message: plan items whose search failed (answers: run_id, term, body, error; an error
    is "Type: message")."""
    failed = answers.where(F.col("error").isNotNull()).select("run_id", "term", "error")
    kind, message = F.substring_index("error", ": ", 1), F.regexp_replace("error", r"^[^:]*: ", "")
    return plan_items.join(failed, ["run_id", "term"]).select("run_id", "term", "target_source", kind.alias("error_type"), message.alias("message"))
