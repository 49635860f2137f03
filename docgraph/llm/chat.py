"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "</s>"
LOSS_ROLES = ("assistant",)
#: What a tokenizer could take for control: the template's marks and other common ones.
CONTROL = r"(?:\|turn\|>|\|text\|>|/?s>|/?INST\])"
BREAK = "\u2060"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with their types, arrays as ``[]``; whole numbers of all widths are of one type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [f"{at}:{'integer' if isinstance(kind, T.IntegralType) else kind.simpleString()}"]


def fingerprint(schema: T.StructType) -> str:
    """Hash of the sorted field paths; the order of columns does not matter."""
    return hashlib.sha256("\n".join(sorted(paths(schema))).encode()).hexdigest()[:16]


def _key(*found: str) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


#: fingerprint -> (columns, mapping). A mapping is text alone: ``turns`` names an array of turns and its role and text
#: fields, ``fixed`` lists (role, column) in order (null columns give no turn), ``rows`` names the columns of a table
#: with one row a turn.
MAPPINGS = {
    _key("conv_id:integer", "turn:integer", "role:string", "text:string"): {"id": "conv_id", "rows": ("turn", "role", "text")},
    _key("id:integer", "prompt:string", "response:string"): {"id": "id", "fixed": (("user", "prompt"), ("assistant", "response"))},
    _key("id:integer", "prompt:string", "completion:string"): {"id": "id", "fixed": (("user", "prompt"), ("assistant", "completion"))},
    _key("id:integer", "instruction:string", "input:string", "output:string"): {"id": "id", "fixed": (("user", "instruction+input"), ("assistant", "output"))},
    _key("id:integer", "messages[].role:string", "messages[].content:string"): {"id": "id", "turns": ("messages", "role", "content")},
    _key("id:integer", "conversations[].from:string", "conversations[].value:string"): {"id": "id", "turns": ("conversations", "from", "value")},
}
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


def canonical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>), whichever known layout ``df`` has.

    ``columns`` names those to fingerprint where the table has others too.  A table of no known layout is an error
    that names its paths.  Null texts count as empty, null roles as ''; turns are ordered by number (null first), then
    role and text, so repeated numbers have one order and repeated rows are turns of their own; a null id is an id of
    its own; an empty table gives none. Texts of any length are taken whole; a conversation is put together in one task.
    """
    df = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    found = fingerprint(df.schema)
    if found not in MAPPINGS:
        raise ValueError(f"no mapping for layout {found}: {sorted(paths(df.schema))}")
    how = MAPPINGS[found]
    text = lambda c: F.coalesce(c, F.lit(""))
    if "rows" in how:
        turn, role, body = how["rows"]
        one = F.struct(F.col(turn).cast("long").alias("turn"), text(F.col(role)).alias("role"), text(F.col(body)).alias("text"))
        turns = df.groupBy(F.col(how["id"]).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    elif "turns" in how:
        array, role, body = how["turns"]
        each = F.transform(F.coalesce(F.col(array), F.array()), lambda t, i: F.struct(i.cast("long").alias("turn"), text(t[role]).alias("role"), text(t[body]).alias("text")))
        turns = df.select(F.col(how["id"]).alias("conv_id"), each.alias("turns"))
    else:
        parts = []
        for i, (role, names) in enumerate(how["fixed"]):
            cols = [F.col(n) for n in names.split("+")]
            joined = F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")), "\n") if len(cols) > 1 else text(cols[0])
            parts.append(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), joined.alias("text")))
        turns = df.select(F.col(how["id"]).alias("conv_id"), F.array(*parts).alias("turns"))
    if "rows" in how:
        return turns
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return turns.withColumn("turns", F.transform("turns", lambda t: t.withField("role", F.coalesce(names[t["role"]], t["role"]))))


def escape(text: Column) -> Column:
    """Break each control string after its first character; those already broken get one more mark, so it can be undone."""
    return F.regexp_replace(text, rf"([<\[]{BREAK}*)(?={CONTROL})", f"$1{BREAK}")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]{BREAK}*){BREAK}(?={CONTROL})", "$1")


def formatted(turns: Column) -> Column:
    """One string: every turn opened, named and closed by control marks, which occur nowhere else in it."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(CLOSE))), "")


def read_back(out: Column) -> Column:
    """Turns (role, text) read from a formatted string alone."""
    quoted = lambda s: "\\Q" + s + "\\E"
    parts = F.filter(F.split(out, quoted(CLOSE)), lambda p: p.startswith(OPEN))

    def turn(part):
        cut = F.split(F.substr(part, F.lit(len(OPEN) + 1)), quoted(BODY), 2)
        return F.struct(unescape(cut[0]).alias("role"), unescape(cut[1]).alias("text"))

    return F.transform(parts, turn)


def loss_spans(out: Column) -> Column:
    """Code point spans [start, stop) of the formatted string that carry loss: the texts of loss roles, without marks."""
    parts = F.filter(F.split(out, "\\Q" + CLOSE + "\\E"), lambda p: p.startswith(OPEN))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc, part):
        head = F.instr(part, BODY) - 1 + len(BODY)
        role = unescape(F.substr(part, F.lit(len(OPEN) + 1), head - len(BODY) - len(OPEN)))
        span = F.struct((acc["at"] + head).cast("int").alias("start"), (acc["at"] + F.length(part)).cast("int").alias("stop"))
        spans = F.when(role.isin(*LOSS_ROLES), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(part) + len(CLOSE)).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(parts, begin, step, lambda acc: acc["spans"])


def format_chats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """conv_id, formatted text and loss spans of every conversation of ``df``."""
    turns = canonical(df, columns)
    return turns.select("conv_id", formatted(F.col("turns")).alias("formatted")).withColumn("loss_spans", loss_spans(F.col("formatted")))


EXTRA = "</s>[INST] ok [/INST]"


def op4(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id bigint, turn bigint, role string, text string")
    out = format_chats(rows.unionByName(extra), ["conv_id", "turn", "role", "text"])
    back = out.withColumn("back", read_back(F.col("formatted")))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))), "")
    back = back.withColumn("loss", masked)
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{EXTRA}'), (-7, 1, 'assistant', '{EXTRA}')),
e as (
  select *, length(role) + length(text) + {len(OPEN) + len(BODY) + len(CLOSE)}
    + len(regexp_extract_all(role, '[<\[]\x{{2060}}*(?:\|turn\|>|\|text\|>|/?s>|/?INST\])'))
    + len(regexp_extract_all(text, '[<\[]\x{{2060}}*(?:\|turn\|>|\|text\|>|/?s>|/?INST\])')) as chars
  from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""
