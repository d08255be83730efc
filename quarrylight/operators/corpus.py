"""The knowledge corpus: reading, chunking, integrity, stack profiles, citations and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.text import collapse
from quarrylight.operators.policy import OfficialSources

# What a document's metadata must hold.
STACK_FIELDS = (
    "stack_id", "stack_name", "topic", "brief_description", "technical_description", "categories", "use_cases", "supported_gap_types",
)
# Needs that the corpus may claim to answer.
TARGETS = (
    "model_serving", "llm_customization", "data_acceleration", "voice_ai", "computer_vision", "robotics_simulation",
    "healthcare_ai", "cybersecurity_ai", "inception_program_fit", "partner_ecosystem",
)
_META = "struct<stack_id:string,stack_name:string,topic:string,brief_description:string,technical_description:string,categories:array<string>,use_cases:array<string>,supported_gap_types:array<string>>"
DOCUMENT = f"schema_version string, corpus_version string, document_id string, title string, source_url string, source_type string, ingested_at string, metadata {_META}"
CHUNK = "schema_version string, corpus_version string, chunk_id string, document_id string, chunk_index int, topic string, text string"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The corpus row (schema_version, corpus_version), documents and chunks of a corpus JSON file, with their positions."""
    kind = f"schema_version string, corpus_version string, documents array<struct<{_as_struct(DOCUMENT)}>>, chunks array<struct<{_as_struct(CHUNK)}>>"
    whole = spark.read.schema(kind).json(path, multiLine=True)
    one = lambda c: whole.select(F.posexplode(c).alias("pos", "x")).select("pos", "x.*")
    return whole.select("schema_version", "corpus_version"), one("documents"), one("chunks")


def _as_struct(ddl: str) -> str:
    """Fields of a DDL string as those of a struct type."""
    return ",".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))


def chunk_blocks(documents: DataFrame, text: str = "text", pattern: str = "\n") -> DataFrame:
    """chunk_id, document_id, chunk_index, text: blocks of a text, white space collapsed, empty ones left out."""
    blocks = F.filter(F.transform(F.split(text, pattern), collapse), lambda b: b != "")
    found = documents.select("document_id", F.posexplode(blocks).alias("chunk_index", "text"))
    name = F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))
    return found.select(name.alias("chunk_id"), "document_id", "chunk_index", "text")


def document_issues(documents: DataFrame, official: OfficialSources) -> DataFrame:
    """document_id, reason: the first reason against each document that is not accepted."""
    reason = official.issue(F.col("source_url"), F.col("source_type"))
    return documents.select("document_id", reason.alias("reason")).where("reason IS NOT NULL")


def _has_value(c: Column, is_list: bool) -> Column:
    if is_list:
        return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: F.trim(x) != ""), F.lit(False))
    return F.coalesce(F.trim(c) != "", F.lit(False))


def corpus_issues(corpus: DataFrame, documents: DataFrame, chunks: DataFrame, official: OfficialSources) -> DataFrame:
    """document_id, reason: everything wrong with documents, chunks and how they fit; no rows if nothing is."""
    bad = document_issues(documents, official)
    accepted = documents.join(bad.select("document_id").distinct(), "document_id", "left_anti")
    ids = accepted.select("document_id").distinct()
    version = corpus.select(F.col("schema_version").alias("sv"), F.col("corpus_version").alias("cv"))  # one row
    order = Window.partitionBy("chunk_id").orderBy("pos")
    of_chunk = lambda df, text: df.select("document_id", F.concat(F.lit(f"{text}:"), "chunk_id").alias("reason"))
    repeated = of_chunk(chunks.withColumn("n", F.row_number().over(order)).where("n > 1"), "duplicate_chunk_id")
    orphans = of_chunk(chunks.join(ids, "document_id", "left_anti"), "chunk_document_id_not_found")
    own = chunks.join(ids, "document_id", "left_semi").crossJoin(F.broadcast(version))
    expected = F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"))
    unstable = own.where(F.col("chunk_id") != expected).select(
        "document_id", F.concat(F.lit("unstable_chunk_id:"), "chunk_id", F.lit(":expected:"), expected).alias("reason")
    )
    docs = accepted.crossJoin(F.broadcast(version))
    of_doc = lambda cond, reason: docs.where(cond).select("document_id", F.lit(reason).alias("reason"))
    index = own.groupBy("document_id").agg(F.array_sort(F.collect_list("chunk_index")).alias("actual"))
    right = F.transform(F.sequence(F.lit(1), F.size("actual")), lambda i: i - 1)
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    gaps = index.where(F.col("actual") != right.cast("array<int>")).select(
        "document_id",
        F.concat(F.lit("non_consecutive_chunk_indices:expected:"), joined(right), F.lit(":actual:"), joined(F.col("actual"))).alias("reason"),
    )
    lists = ("categories", "use_cases", "supported_gap_types")
    missing = docs.select("document_id", F.explode(F.array_compact(F.array(
        *[F.when(~_has_value(F.col(f"metadata.{f}"), f in lists), F.lit(f"missing_stack_metadata:{f}")) for f in STACK_FIELDS]
    ))).alias("reason"))
    topics = docs.select("document_id", F.coalesce("metadata.topic", F.lit("")).alias("main"))
    topic = of_chunk(own.join(topics, "document_id").where("main <> '' AND topic <> main"), "chunk_topic_mismatch")
    unsupported = docs.select("document_id", F.explode("metadata.supported_gap_types").alias("gap")).where(~F.col("gap").isin(*TARGETS))
    parts = [
        bad,
        repeated,
        orphans,
        of_chunk(own.where("schema_version <> sv"), "chunk_schema_version_mismatch"),
        of_chunk(own.where("corpus_version <> cv"), "chunk_corpus_version_mismatch"),
        unstable,
        of_doc(F.col("schema_version") != F.col("sv"), "document_schema_version_mismatch"),
        of_doc(F.col("corpus_version") != F.col("cv"), "document_corpus_version_mismatch"),
        docs.join(own.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit("missing_citable_chunk").alias("reason")),
        gaps,
        missing,
        topic,
        unsupported.select("document_id", F.concat(F.lit("unsupported_gap_type:"), "gap").alias("reason")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stack_profiles(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a document: its stack, topic (else its first chunk's) and chunk ids in order."""
    held = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "topic"))).alias("cs"))
    joined = documents.join(held, "document_id", "left")
    return joined.select(
        "corpus_version",
        "document_id",
        F.coalesce("metadata.stack_id", "document_id").alias("stack_id"),
        F.coalesce("metadata.stack_name", "title").alias("stack_name"),
        F.coalesce("metadata.topic", F.get("cs", F.lit(0))["topic"], F.lit("")).alias("topic"),
        F.coalesce("metadata.supported_gap_types", F.array().cast("array<string>")).alias("supported_gap_types"),
        "source_url",
        "source_type",
        F.coalesce(F.transform("cs", lambda c: c["chunk_id"]), F.array().cast("array<string>")).alias("citation_chunk_ids"),
    )


def citations(results: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Results with what a citation needs; a result whose document is not there goes, one that names another document than its
    chunk's fails."""
    excerpt = chunks.select("chunk_id", F.col("text").alias("excerpt"), F.col("document_id").alias("chunk_document"))
    source = documents.select("document_id", F.col("title").alias("document_title"), "source_url", "source_type", "ingested_at")
    wrong = F.raise_error(F.concat(F.lit("citation_document_mismatch:"), F.col("chunk_id").cast("string"))).cast("boolean")
    matched = results.join(excerpt, "chunk_id").where(F.when(F.col("document_id") != F.col("chunk_document"), wrong).otherwise(F.lit(True)))
    return matched.drop("chunk_document").join(source, "document_id")


def stack_targets(gaps: DataFrame, profiles: DataFrame) -> DataFrame:
    """gaps (gap_type) with the stacks that support the type or have it as topic: two equi-joins, each pair once."""
    by_support = profiles.select("document_id", "stack_name", F.explode("supported_gap_types").alias("gap_type"))
    by_topic = profiles.select("document_id", "stack_name", F.col("topic").alias("gap_type"))
    return gaps.join(by_support.unionByName(by_topic).distinct(), "gap_type")
