r"""Chat formatting by schema fingerprint, in DataFrame functions only.

Records come in many layouts, as JSON or as one struct type that has the fields of all, null where a
record lacks them. The fingerprint of a record is the hash of its nested field paths (values and scalar
types left out), the same for either form, so that all records of one layout share it. A registry maps
fingerprints to declarative mappings, each of which turns its layout into canonical turns
array<struct<role, text>>. Turns are then written by a template:

    <turn>role\ntext</turn>\n

Inside roles and texts a backslash is doubled, `</turn>` becomes `<\/turn>`, and in roles a line break
becomes \n, so `</turn>` only ever ends a turn, the first line break of a turn only ever ends its role,
and reading back is exact. The loss mask is a list of (start, length) in code points, one for each
assistant text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a JSON text beyond which the parser gives up; longer records must come as structs.
JSON_CHARS = 20_000_000

OPEN, CLOSE = "<turn>", "</turn>"
END = CLOSE + "\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    sample: a record of the layout, whose field paths give the fingerprint. Either `turns` is the path
    of an array of messages with the fields `role` and `text`, or `fields` lists (role, path) of single
    texts, in order; texts that are null or missing give no turn there, and an empty one of a role in
    `optional` neither. roles: names to be replaced by canonical ones.
    """

    name: str
    sample: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("messages", '{"messages":[{"role":"","content":""}]}', turns="$.messages"),
    Mapping("conversations", '{"conversations":[{"from":"","value":""}]}', turns="$.conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", '{"prompt":"","completion":""}', fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("response", '{"prompt":"","response":""}', fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("instruction", '{"instruction":"","output":""}', fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input", '{"instruction":"","input":"","output":""}', fields=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")), optional=("$.input",)),
    Mapping("instruction_system", '{"system":"","instruction":"","output":""}', fields=(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output")), optional=("$.system",)),
    Mapping("nested_chat", '{"chat":{"turns":[{"speaker":"","utterance":""}]}}', turns="$.chat.turns", role="speaker", text="utterance"),
)


def _paths_of(value: Column, kind: T.DataType) -> Column:
    """The fields that a value of a native type has, as field_paths() writes them."""
    if isinstance(kind, T.StructType):
        parts = [F.when(value[f.name].isNotNull(), F.concat(F.lit(f"{f.name}: "), _paths_of(value[f.name], f.dataType))) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *parts), F.lit(">"))
    if isinstance(kind, T.ArrayType):
        inner = F.lit("_")
        if isinstance(kind.elementType, T.StructType):
            inner = F.lit("OBJECT<" + ", ".join(f"{n}: _" for n in sorted(kind.elementType.names)) + ">")
        return F.concat(F.lit("ARRAY<"), F.when(F.size(value) > 0, inner).otherwise(F.lit("_")), F.lit(">"))
    return F.lit("_")


def field_paths(record: Column, kind: T.DataType = T.StringType()) -> Column:
    """The nested field names of a record in a fixed order, as text without the types of values; null if it is no JSON.

    Field names are sorted, and scalar types give way to `_`, so a null, a number and a text in the same
    place make no difference in JSON. An empty array says nothing about its elements and differs from a
    filled one. kind: a struct type for native records, of which null fields count as missing.
    """
    if isinstance(kind, T.StructType):
        return F.when(record.isNotNull(), _paths_of(record, kind))
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r"(^|[:<] ?)(VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|BINARY|VARIANT|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\))(?=$|[,>])", "$1_")


def fingerprint(record: Column, kind: T.DataType = T.StringType()) -> Column:
    """64-bit hash of the nested field paths; null if it is no JSON."""
    paths = field_paths(record, kind)
    return F.when(paths.isNotNull(), F.xxhash64(paths))


def _at(record: Column, kind: T.DataType, path: str) -> tuple[Column, T.DataType] | None:
    """What a path such as $.a.b names in a native record, and its type; None if the type has no such place."""
    for name in path.removeprefix("$.").split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        record, kind = record[name], kind[name].dataType
    return record, kind


def turns_of(record: Column, mapping: Mapping, kind: T.DataType = T.StringType()) -> Column:
    """Canonical turns of a record that has the layout of the mapping."""
    names = dict(mapping.roles)
    native = isinstance(kind, T.StructType)

    def canonical(role: Column) -> Column:
        out = role
        for old, new in names.items():
            out = F.when(role == old, new).otherwise(out)
        return out

    v = None if native else F.try_parse_json(record)
    if mapping.turns is not None:
        if native:
            found = _at(record, kind, mapping.turns)
            if found is None or not {mapping.role, mapping.text} <= set(getattr(getattr(found[1], "elementType", None), "names", ())):
                return F.lit(None).cast(TURNS)
            rows = found[0]
        else:
            rows = F.try_variant_get(v, mapping.turns, f"array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>")
        return F.transform(rows, lambda m: F.struct(F.coalesce(canonical(m[mapping.role]), F.lit("")).alias("role"), F.coalesce(m[mapping.text], F.lit("")).alias("text")))

    def text_at(path: str) -> Column:
        if not native:
            return F.try_variant_get(v, path, "string")
        found = _at(record, kind, path)
        return F.lit(None).cast("string") if found is None else found[0].cast("string")

    parts = [F.struct(F.lit(role).alias("role"), text_at(path).alias("text")) for role, path in mapping.fields]
    empty = [F.lit(path in mapping.optional) for _, path in mapping.fields]
    rows = F.arrays_zip(F.array(*parts).alias("t"), F.array(*empty).alias("o"))
    kept = F.filter(rows, lambda x: x["t"]["text"].isNotNull() & ~(x["o"] & (x["t"]["text"] == "")))
    return F.transform(kept, lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text")))


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with fingerprint, layout (the mapping's name) and turns; the last two are null for a record of no known layout.

    The registry is a fixed argument, so choosing by fingerprint is one CASE expression and needs no
    join or shuffle. An element of an array that lacks a field, or a null field, gives an empty text.
    A null record, or a text that isn't JSON, has null in all three. Nothing is dropped: a JSON text that
    is too long for the parser (JSON_CHARS) fails the query, and has to come as a struct, where only the
    length of a string (2 GiB) is a limit. No rows: no rows. Other columns pass through; the record's
    column may have any name but those of the results.
    """
    kind = records.schema[record].dataType
    known = records.sparkSession.createDataFrame([(m.name, m.sample) for m in mappings], "name string, sample string")
    prints = {r["name"]: r["f"] for r in known.select("name", fingerprint(F.col("sample")).alias("f")).collect()}
    if len(set(prints.values())) < len(prints):
        raise ValueError("two mappings of one layout")
    mark = fingerprint(F.col(record), kind)
    if not isinstance(kind, T.StructType):
        mark = F.when(mark.isNull() & (F.length(record) > JSON_CHARS), F.raise_error(F.lit("record too long for the JSON parser: pass it as a struct")).cast("long")).otherwise(mark)
    out = records.withColumn("fingerprint", mark)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        here = F.col("fingerprint") == F.lit(prints[m.name])
        layout = F.when(here, m.name).otherwise(layout)
        turns = F.when(here, turns_of(F.col(record), m, kind).cast(TURNS)).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": turns})


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(CLOSE), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Backslashes come in pairs, or one before / or n; splitting at pairs from the left leaves the single ones."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\/turn>"), F.lit(CLOSE))), "\\")


def formatted(turns: Column) -> Column:
    """The template's text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))), "")


def loss_spans(text: Column, role: str = "assistant") -> Column:
    """array<struct<start, length>>: the code points of formatted text that belong to texts of the role, from 0."""
    pieces = F.split(text, END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p) + len(END)).cast("long").alias("at"),
        F.when(F.substring_index(p, "\n", 1) == OPEN + role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(OPEN + role) + 1).cast("long").alias("start"), (F.length(p) - len(OPEN + role) - 1).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def read_back(text: Column) -> Column:
    """Canonical turns out of formatted text."""
    pieces = F.split(text, END, -1)
    first = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(unescape(F.substr(first(p), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(p, F.length(first(p)) + 2)).alias("text")))


def format_chats(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """canonical_turns() with formatted and loss_spans. No turns: empty text, no spans; unknown layout: null."""
    out = canonical_turns(records, record, mappings).withColumn("formatted", formatted(F.col("turns")))
    return out.withColumn("loss_spans", loss_spans(F.col("formatted")))


def as_records(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key and record: one struct of the messages layout for each key, its rows ordered by `order`, role and text, null first.

    Null roles and texts count as empty. Repeated rows are turns of their own. A null key is a key. No
    rows: no rows. Very long texts pass whole. Other columns are not read.
    """
    turn = F.struct(F.col(order).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    ordered = F.sort_array(F.collect_list(turn))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy(key).agg(F.struct(messages.alias("messages")).alias("record"))
