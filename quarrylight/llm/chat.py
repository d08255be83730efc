r"""Chat formatting: heterogeneous records to canonical turns by schema fingerprint, then to a template with a loss mask.

A record is a struct (or a JSON string of one). Its fingerprint is the md5 of the sorted nested field paths that hold a
value; a declarative layout names the paths it needs, those it may have, and an SQL expression for the turns. All of it
is DataFrame and SQL functions.

Template: ``<|im_start|>ROLE\nTEXT<|im_end|>\n`` a turn. In roles and texts a backslash is doubled and ``<|`` becomes
``<\|``; in roles a newline becomes ``\n``. So no text can hold a control string, and unescaping is exact.

Defined results: null text is empty, null role is empty; turns with the same number are ordered by role, then text;
repeated rows are repeated turns; records of no known layout are kept apart (layout null) and have no turns; an empty
table gives no conversations; fields no layout names are ignored. A conversation is one row, its turns an array: one of very
many turns needs an executor that holds its text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
_TEXTS = "role text system prompt completion response instruction input output question answer".split()


def _messages(*fields: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))


RECORD_SCHEMA = T.StructType(
    [
        T.StructField("turn", T.LongType()),
        *[T.StructField(f, T.StringType()) for f in _TEXTS],
        T.StructField("messages", _messages("role", "content")),
        T.StructField("conversations", _messages("from", "value")),
    ]
)


@dataclass(frozen=True)
class Layout:
    """needs: paths that must be there; may: paths that can be; turns: SQL for array<struct<role,text>> over `rec`."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: str

    def fingerprints(self) -> list[str]:
        extra = chain.from_iterable(combinations(self.may, k) for k in range(len(self.may) + 1))
        return [fingerprint_of([*self.needs, *e]) for e in extra]


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


_SYSTEM = f"IF(rec.system IS NULL, array(), array({_turn(chr(39) + 'system' + chr(39), 'rec.system')}))"


def _pair(ask: str, reply: str) -> str:
    turns = f"array({_turn(chr(39) + 'user' + chr(39), ask)}, {_turn(chr(39) + 'assistant' + chr(39), reply)})"
    return f"concat({_SYSTEM}, {turns})"


LAYOUTS = (
    Layout("turn_row", (), ("turn", "role", "text"), f"array({_turn('rec.role', 'rec.text')})"),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), _pair("rec.prompt", "rec.completion")),
    Layout("prompt_response", ("prompt", "response"), ("system",), _pair("rec.prompt", "rec.response")),
    Layout("question_answer", ("question", "answer"), ("system",), _pair("rec.question", "rec.answer")),
    Layout(
        "instruction",
        ("instruction", "output"),
        ("input", "system"),
        _pair(r"concat_ws('\n\n', rec.instruction, nullif(rec.input, ''))", "rec.output"),
    ),
    Layout(
        "messages",
        ("messages[].content", "messages[].role"),
        ("system",),
        f"concat({_SYSTEM}, transform(rec.messages, m -> {_turn('m.role', 'm.content')}))",
    ),
    Layout(
        "from_value",
        ("conversations[].from", "conversations[].value"),
        ("system",),
        "concat(%s, transform(rec.conversations, m -> %s))"
        % (_SYSTEM, _turn("CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END", "m.value")),
    ),
)


def _any_has(items: Column, field: str) -> Column:
    return F.exists(items, lambda x: x[field].isNotNull())


def present_paths(col: Column, kind: T.StructType, prefix: str = "") -> list[Column]:
    """For each leaf of a struct, its path if it holds a value, else null."""
    out = []
    for f in kind.fields:
        at, path = col[f.name], f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += present_paths(at, f.dataType, path + ".")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            for g in f.dataType.elementType.fieldNames():
                out.append(F.when(_any_has(at, g), F.lit(f"{path}[].{g}")))
        else:
            out.append(F.when(at.isNotNull(), F.lit(path)))
    return out


def canonical_turns(records: DataFrame, key: str, record: str = "rec", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """key, fingerprint, layout, turn, pos, role, text: a row for each turn; a row with layout null for a record of no layout.

    `record` is a column of RECORD_SCHEMA (any subset of its fields), or a JSON string. A struct without any value is a turn
    without role and text; a JSON record that says nothing any layout knows is of no layout.
    """
    kind = records.schema[record].dataType
    is_json = isinstance(kind, T.StringType)
    if is_json:
        records = records.withColumn(record, F.from_json(record, RECORD_SCHEMA))
        kind = RECORD_SCHEMA
    known = {f.name: f for f in RECORD_SCHEMA.fields}
    fields = [
        (F.col(record)[f.name] if f.name in kind.fieldNames() else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in known.values()
    ]
    has = [f for f in RECORD_SCHEMA.fields if f.name in kind.fieldNames()]
    rows = records.select(F.col(key).alias("key"), F.struct(*fields).alias("rec"))
    paths = F.array_sort(F.array_compact(F.array(*present_paths(F.col("rec"), T.StructType(has)))))
    rows = rows.withColumn("fingerprint", F.md5(F.array_join(paths, "\n")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in reversed(layouts):
        known_prints = [p for p in x.fingerprints() if not (is_json and p == fingerprint_of([]))]
        hit = F.col("fingerprint").isin(known_prints)
        layout, turns = F.when(hit, F.lit(x.name)).otherwise(layout), F.when(hit, F.expr(x.turns)).otherwise(turns)
    rows = rows.select("key", "fingerprint", layout.alias("layout"), F.col("rec.turn").alias("turn"), turns.alias("turns"))
    rows = rows.select("key", "fingerprint", "layout", "turn", F.posexplode_outer("turns").alias("pos", "t"))
    return rows.select("key", "fingerprint", "layout", "turn", "pos", F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("<\\|"), F.lit("<|"))), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    one = lambda p: F.replace(F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(parts, one), "\\")


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """key, formatted, loss_spans: the rendered conversation and, for each turn to learn, where its text lies.

    A span is (turn, start, length): the turn's place in the conversation, and code points in that turn's rendering.
    """
    said = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = turns.where(F.col("layout").isNotNull()).select("key", F.struct("turn", "pos", *said).alias("t"))
    grouped = rows.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    escaped = lambda t: F.struct(
        t["role"].isin(*learn).alias("learn"), escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")
    )
    grouped = grouped.select("key", F.transform("ts", escaped).alias("ts"))
    piece = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))
    span = lambda t, i: F.when(
        t["learn"],
        F.struct(
            i.cast("bigint").alias("turn"),
            (F.char_length(t["role"]) + len(START) + 1).cast("bigint").alias("start"),
            F.char_length(t["text"]).cast("bigint").alias("length"),
        ),
    )
    return grouped.select(
        "key",
        F.array_join(F.transform("ts", piece), "").alias("formatted"),
        F.filter(F.transform("ts", span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """key, turns (array of role, text), loss_texts (array), formatted_chars, all from the rendering and its mask."""
    pieces = F.split("formatted", r"<\|im_start\|>")
    rows = formatted.withColumn("pieces", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        at = F.char_length(role) + 2
        text = F.substring(p, at, F.char_length(p) - at + 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    masked = lambda s: unescape(
        F.substring(F.get("pieces", s["turn"].cast("int")), (s["start"] - len(START) + 1).cast("int"), s["length"].cast("int"))
    )
    return rows.select(
        "key",
        F.transform("pieces", turn).alias("turns"),
        F.transform("loss_spans", masked).alias("loss_texts"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("key").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       sum(length(role) + 24 + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
