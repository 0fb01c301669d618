"""Conversations as one training text each, with a loss mask and typed content parts. DataFrame functions only.

A turn holds an ordered array of parts (PARTS). The visitor turns each part into text: a text part is escaped, an image,
audio or document part becomes an ordered placeholder such as ``<|image:1|>``; what it referred to and how many tokens the
placeholder expands to are recorded. The template wraps a turn as ``<s>role`` newline ``text</s>``, a user's text moreover
as ``[INST] text [/INST]``. Texts may hold such control strings themselves: there each gets one backslash after its first
character, and one more if it already has some, which reading back takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.arrays import running_sum

PARTS = "array<struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"
OPEN, CLOSE, USER_OPEN, USER_CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
#: A control string inside a text: its first character, backslashes, the rest.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|[a-z]+:[0-9]+\|>)"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|[a-z]+:[0-9]+\|>)"
#: Tokens of an image per tile of TILE pixels square, of a second of audio, of a page of a document.
TILE, TILE_TOKENS, IMAGE_BASE, SECOND_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 600
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def escape_role(role: Column) -> Column:
    """A role on one line: percent signs and newlines as %25 and %0A, control strings as in texts."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """One text part for each text; null is the empty text."""
    part = [F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref")]
    part += [F.lit(None).cast(t).alias(n) for n, t in (("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("pages", "bigint"))]
    return F.array(F.struct(*part))


def _tiles(pixels: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(pixels, F.lit(0)) / TILE)).cast("bigint")


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text. Unknown sizes count as one tile, second or page."""
    whole = lambda x: F.greatest(F.lit(1), F.ceil(F.coalesce(x, F.lit(1)))).cast("bigint")
    return (
        F.when(part["type"] == "image", IMAGE_BASE + TILE_TOKENS * _tiles(part["width"]) * _tiles(part["height"]))
        .when(part["type"] == "audio", SECOND_TOKENS * whole(part["seconds"]))
        .when(part["type"] == "document", PAGE_TOKENS * whole(part["pages"]))
        .otherwise(F.lit(0)).cast("bigint")
    )


def visit(parts: Column) -> Column:
    """What the parts of a turn become: ``content``, ``attachments`` (type, number in its turn, ref, tokens), ``tokens``.

    Parts keep their order; attachments are numbered from 1 in each turn. Parts of another type, null parts and null texts
    give nothing; null parts as a whole are no parts.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull() & p["type"].isin("text", "image", "audio", "document"))
    placed = F.filter(parts, lambda p: p["type"] != "text")
    before = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), lambda p: p["type"] != "text"))
    text = lambda p: F.coalesce(escape(p["text"]), F.lit(""))
    mark = lambda p, i: F.concat(F.lit("<|"), p["type"], F.lit(":"), before(i).cast("string"), F.lit("|>"))
    content = F.array_join(F.transform(parts, lambda p, i: F.when(p["type"] == "text", text(p)).otherwise(mark(p, i))), "")
    attachments = F.transform(
        placed, lambda p, i: F.struct(p["type"].alias("type"), (i + 1).alias("number"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))
    )
    total = F.aggregate(placed, F.lit(0).cast("bigint"), lambda acc, p: acc + expanded_tokens(p))
    return F.struct(content.alias("content"), attachments.alias("attachments"), total.alias("tokens"))


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """A row for each conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``turns`` has a row for each turn with a ``parts`` column of type PARTS. Turns go by number, then role, then content;
    repeated rows are repeated turns; a null role is the empty role; null numbers come first and a null conv_id is a
    conversation of its own. ``loss_spans`` are (first, length) in code points of the assistant's contents, in order, also
    of empty ones. A conversation is one text and so is put together in one task, whatever its length. No rows: no rows.
    """
    seen = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), escape_role(F.coalesce(F.col(role), F.lit(""))).alias("role"),
        visit(F.col(parts)).alias("v"),
    )
    head, tail = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n")), F.lit(CLOSE)
    user = F.col("role") == "user"
    seen = seen.select(
        "conv_id", "turn", "role", "v",
        F.concat(head, F.when(user, F.lit(USER_OPEN)).otherwise(F.lit(""))).alias("head"),
        F.concat(F.when(user, F.lit(USER_CLOSE)).otherwise(F.lit("")), tail).alias("tail"),
    )
    pieces = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("v.content").alias("content"), "head", "tail", F.col("v.attachments").alias("attachments"), F.col("v.tokens").alias("tokens"))))
    chats = seen.groupBy("conv_id").agg(pieces.alias("pieces"))
    size = lambda p: (F.length(p["head"]) + F.length(p["content"]) + F.length(p["tail"])).cast("bigint")
    chats = chats.withColumn("starts", running_sum(F.transform("pieces", size)))
    spans = F.zip_with("pieces", "starts", lambda p, s: F.when(p["role"] == LOSS_ROLE, F.struct((s + F.length(p["head"])).alias("first"), F.length(p["content"]).cast("bigint").alias("length"))))
    notes = F.transform("pieces", lambda p, i: F.transform(p["attachments"], lambda a: F.struct(i.alias("turn"), a["type"].alias("type"), a["number"].alias("number"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    return chats.select(
        "conv_id", F.size("pieces").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], p["tail"])), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"), F.flatten(notes).alias("attachments"),
        F.aggregate("pieces", F.lit(0).cast("bigint"), lambda acc, p: acc + p["tokens"]).alias("expanded_tokens"),
    )


def _pieces(formatted: Column) -> Column:
    """The turns of a formatted text: where each starts, and what stands between its opening and closing marks."""
    inside = F.split(formatted, CLOSE, -1)
    inside = F.slice(inside, 1, F.size(inside) - 1)
    starts = running_sum(F.transform(inside, lambda x: (F.length(x) + len(CLOSE)).cast("bigint")))
    return F.zip_with(inside, starts, lambda x, s: F.struct(s.alias("start"), x.alias("piece")))


def read_back(formatted: Column) -> Column:
    """Roles and texts of a formatted text, unescaped: an array of (role, text). Placeholders stay in the text."""

    def turn(p: Column) -> Column:
        body = F.substring(p["piece"], F.lit(len(OPEN) + 1), F.length(p["piece"]))
        cut = F.instr(body, "\n")
        role, text = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + 1, F.length(body))
        plain = F.when(role == "user", F.substring(text, F.lit(len(USER_OPEN) + 1), F.length(text) - len(USER_OPEN) - len(USER_CLOSE))).otherwise(text)
        return F.struct(unescape_role(role).alias("role"), unescape(plain).alias("text"))

    return F.transform(_pieces(formatted), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. Each span is cut out of the turn that it lies in."""
    pieces = F.filter(_pieces(formatted), lambda p: F.startswith(p["piece"], F.lit(f"{OPEN}{LOSS_ROLE}\n")))
    cut = lambda p, s: unescape(F.substring(p["piece"], (s["first"] - p["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.zip_with(pieces, spans, cut), "")


def query(spark, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], said.schema)
    chats = format_chat(said.unionByName(more).withColumn("parts", text_parts(F.col("text"))))
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: From the turns themselves; the length of the formatted text from the template and what escaping adds.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\]|\|[a-z]+:[0-9]+\|>)'))
    + length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|\|[a-z]+:[0-9]+\|>)'))
    + CASE WHEN role = 'user' THEN 15 ELSE 0 END + 8 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
