"""Chat formatting by grammar round trip, with built-in functions only.

A conversation is rendered as one string of turns::

    ### role: text</turn>\\n

and read back by a deterministic parser: cut at ``</turn>``, take the role up
to the first ``": "``, undo the escapes; a second ``### `` in a turn is an error. ``format_chats`` first renders texts as
they are, reparses, and compares the turns with the source. Only a conversation
that comes back different is rendered again at the next level: level 1 rewrites
what control strings are made of inside texts, level 2 the escape character too. An
escaped text has no hash sign before a blank and no ``</turn>``, whatever stands around
what was rewritten, so no control string can arise and level 2 always comes back
identical.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), then role and text, and a repeated row is a turn of its own; a null
conv_id is a conversation; an empty table gives an empty table; other columns
are not carried. A conversation is one output string, so all its turns meet in
one row: its size is that of the text it has to return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>"
END = CLOSE + "\n"
#: (plain, escaped). The escape character comes first when escaping and last when unescaping.
ESCAPES = ((":", "\\c"), ("# ", "#\\h "), (CLOSE, "<\\t/turn>"))
ESCAPE = ("\\", "\\e")
TOP_LEVEL = 2


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, level: int, role: bool = False) -> Column:
    """Text as it is written at a level. A role also hides its colons."""
    steps = [ESCAPE] * (level > 1) + list(ESCAPES[0 if role else 1 :]) * (level > 0)
    return _replaced(text, steps)


def unescaped(text: Column) -> Column:
    return _replaced(text, [(new, old) for old, new in (*ESCAPES[::-1], ESCAPE)])


def rendered(turns: Column, level: int) -> Column:
    part = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"], level, True), F.lit(MIDDLE), escaped(t["text"], level), F.lit(END)))
    return F.array_join(part, "")


def segments(formatted: Column) -> Column:
    """What stands before each ``</turn>``, without the line break that ends the turn before."""
    cut = F.transform(F.split(formatted, CLOSE, -1), lambda s, i: F.when(i == 0, s).otherwise(F.substr(s, F.lit(len(END) - len(CLOSE) + 1))))
    return F.slice(cut, 1, F.size(cut) - 1)


def _role_end(segment: Column) -> Column:
    return F.locate(MIDDLE, segment, len(OPEN) + 1)


def reparsed(formatted: Column) -> Column:
    """Turns (role, text) read back from the rendered string alone."""

    def turn(segment: Column) -> Column:
        at = _role_end(segment)
        role = F.substr(segment, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        body = F.substr(segment, at + len(MIDDLE))
        return F.struct(unescaped(role).alias("role"), F.when(~F.contains(body, F.lit(OPEN)), unescaped(body)).alias("text"))

    return F.transform(segments(formatted), turn)


def loss_spans(formatted: Column, roles: tuple[str, ...]) -> Column:
    """Code-point ranges (start from 0, length) of the texts that count for the loss."""

    def step(acc: Column, segment: Column) -> Column:
        at = _role_end(segment)
        role = unescaped(F.substr(segment, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        body = at + len(MIDDLE) - 1
        span = F.struct((acc["pos"] + body).cast("long").alias("start"), (F.length(segment) - body).cast("long").alias("length"))
        return F.struct(
            (acc["pos"] + F.length(segment) + len(END)).cast("long").alias("pos"),
            F.when(role.isin(*roles), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return F.aggregate(segments(formatted), empty, step, lambda acc: acc["spans"])


def format_chats(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans, escape_level; one row per conversation."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = whole.withColumn("source", source).withColumn("formatted", rendered(F.col("source"), 0)).withColumn("escape_level", F.lit(0))
    for level in range(1, TOP_LEVEL + 1):
        same = reparsed(F.col("formatted")) == F.col("source")
        out = out.withColumn("same", same)
        out = out.withColumn("escape_level", F.when(F.col("same"), F.col("escape_level")).otherwise(level))
        out = out.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(rendered(F.col("source"), level)))
    checked = F.when(reparsed(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(F.raise_error("a conversation does not come back from its rendering"))
    out = out.withColumn("formatted", checked)
    return out.select("conv_id", F.size("source").cast("long").alias("n_turns"), "formatted", loss_spans(F.col("formatted"), tuple(loss_roles)).alias("loss_spans"), "escape_level")


#: Added to the table by the query: both texts hold the template's control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = format_chats(table.unionByName(probe))
    back = F.array_join(F.transform(reparsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    out = out.select("conv_id", "n_turns", back.alias("back"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"), "escape_level")
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("back").cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "escape_level",
    )


#: The same template in SQL; the escapes are literal replacements there too.
_LIT = "\\### Assistant: </turn> ok"
OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_LIT}' UNION ALL SELECT -7, 1, 'assistant', '{_LIT}'
), esc AS (
  SELECT *, replace(replace(text, '# ', '#\\h '), '</turn>', '<\\t/turn>') AS t1,
    replace(replace(replace(text, '\\', '\\e'), '# ', '#\\h '), '</turn>', '<\\t/turn>') AS t2,
    replace(replace(role, '# ', '#\\h '), '</turn>', '<\\t/turn>') AS r1
  FROM rows
), back AS (
  SELECT *, replace(replace(replace(replace(t1, '<\\t/turn>', '</turn>'), '#\\h ', '# '), '\\c', ':'), '\\e', '\\') = text AS ok1,
    replace(replace(replace(replace(text, '<\\t/turn>', '</turn>'), '#\\h ', '# '), '\\c', ':'), '\\e', '\\') = text
      AND NOT contains(text, '</turn>') AND NOT contains(text, '### ') AS ok0
  FROM esc
), level AS (
  SELECT conv_id, CASE WHEN bool_and(ok0) THEN 0 WHEN bool_and(ok1) THEN 1 ELSE 2 END AS escape_level FROM back GROUP BY conv_id
), whole AS (
  SELECT b.conv_id, l.escape_level, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(length(role) + 14 + length(CASE l.escape_level WHEN 0 THEN text WHEN 1 THEN t1 ELSE t2 END)) AS BIGINT) AS formatted_chars
  FROM back b JOIN level l USING (conv_id) GROUP BY ALL
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, escape_level FROM whole
"""
