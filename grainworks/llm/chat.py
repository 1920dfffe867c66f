"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of typed parts.  A visitor flattens them in order: text is escaped, an image,
audio or document part becomes a placeholder, its reference is recorded with the place of the placeholder
and its expanded token count.  Turns are marked and joined by conversation; a segment list says where each
turn's content lies and whether the loss is taken there.  ``parse`` reads the turns back, ``typed_turns`` their
typed parts with references and tokens, ``loss_text`` what the mask covers.

Escaping is reversible: the backslash and the first character of every control string become two-character
codes, so no content can contain a control string, and undoing the codes restores it exactly.

Defined results: null content, text, role or reference is empty; equal turn numbers are ordered by role,
then content; null turns come first; rows with a null conversation id are one conversation; repeated rows
are repeated turns; an empty table gives an empty table; extra columns are ignored.  A conversation is one
formatted row, so it must fit in memory; nothing else grows with a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<s>", "</s>", "<|end|>"
#: control strings of the template and of common chat models, with their escaped forms; the backslash comes first
CODES = [("\\", "\\0"), ("<s>", "\\1s>"), ("</s>", "\\1/s>"), ("<|", "\\1|"), ("[INST]", "\\2INST]"), ("[/INST]", "\\2/INST]")]
UNDO = [("\\2", "["), ("\\1", "<"), ("\\0", "\\")]
LOSS_ROLE = "assistant"
#: tokens that stand for one unit of each attachment type: a tile of an image, a second of audio, a page of a document
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"


def escaped(c: Column) -> Column:
    for old, new in CODES:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def unescaped(c: Column) -> Column:
    for old, new in UNDO:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _role(c: Column) -> Column:
    """A role inside a marker: no bar, so that the marker's end is the first one."""
    return F.replace(escaped(c), F.lit("|"), F.lit("\\3"))


def _unrole(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\3"), F.lit("|")))


def text_part(c: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PARTS)


def visit(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of a list of parts; an unknown type counts as a document."""

    def units(p: Column) -> Column:
        per = F.coalesce(*[F.when(p["type"] == k, F.lit(n)) for k, n in TOKENS_PER_UNIT.items()], F.lit(TOKENS_PER_UNIT["document"]))
        return per * F.coalesce(p["units"], F.lit(1))

    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(False))
    parts = F.coalesce(parts, F.array().cast(PARTS))
    placeholder = lambda p: F.concat(F.lit("<|"), _role(F.coalesce(p["type"], F.lit("document"))), F.lit("|>"))
    content = F.array_join(F.transform(parts, lambda p: F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p))), "")
    held = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), F.coalesce(p["ref"], F.lit("")).alias("ref"), units(p).alias("tokens"), is_text(p).alias("is_text"))), lambda a: ~a["is_text"])
    return content, F.transform(held, lambda a: F.struct(a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))


def formatted(turns: DataFrame, parts: str = "parts", conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row a conversation: (conv, formatted, segments, attachments, attachment_tokens)."""
    content, attachments = visit(F.col(parts))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("content"), attachments.alias("held"))
    mark = F.concat(F.lit("<|role:"), _role(F.col("role")), F.lit("|>"))
    rows = rows.withColumn("piece", F.concat(mark, "content", F.lit(END))).withColumn("from", F.char_length(mark).cast("long"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "content")
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(OPEN))
    start = F.col("at") + F.col("from")
    turn_row = F.struct("at", "piece", F.struct("role", start.alias("start"), F.char_length("content").cast("long").alias("length"), (F.col("role") == LOSS_ROLE).alias("loss")).alias("segment"), F.transform("held", lambda a: F.struct(start.alias("start"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("held"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn_row)).alias("t"))
    out = whole.select(F.col("conv").alias(conv), F.concat(F.lit(OPEN), F.array_join("t.piece", ""), F.lit(CLOSE)).alias("formatted"), F.col("t.segment").alias("segments"), F.flatten("t.held").alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def parse(c: Column) -> Column:
    """The turns (role, content) that a formatted text holds; text is unescaped, placeholders stay."""
    body = F.substring(c, len(OPEN) + 1, 2147483647)
    pieces = F.split(body, r"<\|end\|>")
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(turns, lambda t: F.struct(_unrole(F.regexp_extract(t, r"^<\|role:([^|]*)\|>", 1)).alias("role"), unescaped(F.regexp_replace(t, r"^<\|role:[^|]*\|>", "")).alias("text")))


def content_parts(c: Column) -> Column:
    """The parts of one turn's content: text between placeholders, unescaped, and the placeholders by type, in order; empty texts are left out."""
    # escaped text holds no "<|", so every one starts a placeholder, which ends at the next "|>"
    pieces = F.split(c, r"<\|")
    text = lambda x: F.struct(F.lit("text").alias("type"), unescaped(x).alias("text"))
    held = lambda x: F.struct(_unrole(F.substring_index(x, "|>", 1)).alias("type"), F.lit("").alias("text"))
    after = lambda x: F.substring(x, F.char_length(F.substring_index(x, "|>", 1)) + 3, F.lit(2147483647))
    parts = F.flatten(F.transform(pieces, lambda x, i: F.when(i == 0, F.array(text(x))).otherwise(F.array(held(x), text(after(x))))))
    return F.filter(parts, lambda p: (p["type"] != "text") | (p["text"] != ""))


def typed_turns(done: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, at, role, part, type, text, ref, tokens): a row for each typed part, from the formatted text, its segments and attachments.

    Neighbouring texts of one turn come back as one part; an attachment's reference and tokens come from the record made beside its placeholder.
    """
    turns = done.select(conv, "formatted", "attachments", F.posexplode("segments").alias("at", "s"))
    content = F.substring(F.col("formatted"), F.col("s.start").cast("int") + 1, F.col("s.length").cast("int"))
    own = F.filter("attachments", lambda a: a["start"] == F.col("s.start"))
    parts = turns.select(conv, "at", F.col("s.role").alias("role"), own.alias("own"), F.posexplode(content_parts(content)).alias("part", "p"), content_parts(content).alias("every"))
    nth = F.size(F.filter(F.slice("every", 1, F.col("part") + 1), lambda p: p["type"] != "text"))
    record = F.when(F.col("p.type") != "text", F.get("own", nth - 1))
    return parts.select(conv, "at", "role", "part", "p.type", "p.text", record["ref"].alias("ref"), record["tokens"].alias("tokens"))


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, cut out of the formatted text by the segments' places and unescaped, with nothing between."""
    marked = F.filter(segments, lambda s: s["loss"])
    # four bytes a character, so that a cut costs its own length wherever it lies; a lambda's variable, so that it is made once
    cut = lambda w, s: F.decode(F.substring(w, 4 * s["start"].cast("int") + 1, 4 * s["length"].cast("int")), "UTF-32")
    said = F.transform(F.array(F.encode(formatted, "UTF-32")), lambda w: F.array_join(F.transform(marked, lambda s: unescaped(cut(w, s))), ""))
    return F.get(said, F.lit(0))


def read_back(done: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted text and the places of its loss mask."""
    held = done.select(conv, "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("segments")).alias("loss"))
    held = held.withColumn("said", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    return held.select(conv, F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


#: the same from the table itself, for DuckDB
SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(text, '\\', '\\0'), '<s>', '\\1s>'), '</s>', '\\1/s>'), '<|', '\\1|'), '[INST]', '\\2INST]'), '[/INST]', '\\2/INST]') AS content FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, content)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, content) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(length('<|role:' || role || '|>' || content || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
