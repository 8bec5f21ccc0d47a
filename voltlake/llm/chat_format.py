"""Chat formatting: a visitor flattens typed content parts of turns into one marked string per conversation.

A part is (type, text, ref, width, height, seconds, pages). Text parts are escaped; image, audio and
document parts become placeholders ``[image:3]`` numbered in order over the conversation, with their
reference, measures and the number of tokens they expand to recorded in ``attachments``. A part of another type
fails the job with its name; a null type is text.

Template, per turn: ``<s>`` role ``[INST]`` content ``[/INST]`` ``</s>``. Control strings start with ``<``
or ``[``; in roles and texts these two and the backslash are written ``\\l``, ``\\i`` and ``\\b``, so no text can
contain a control string or a placeholder, and reading reverses it exactly: parts come back typed, with what ``attachments``
hold about them; text parts in a row come back as one, empty ones not at all.

Turns are ordered by (turn, role, content); nulls first. Null text or role is ''. All rows with a null
conversation id form one conversation. A conversation is one row by nature of the format, of 2 GB at most,
so where ids are missing from many rows, give them ids or leave them out first; one shuffle on the conversation serves the offsets and the gathering. All of it are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.llm.common import table

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
#: Tokens that attachments expand to: an image's per patch, a second of audio's, a page's.
PATCH_PIXELS, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 768


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\i"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\i"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


MEASURES = ("width", "height", "seconds", "pages")
TYPES = ("text", "image", "audio", "document")


def _kind(p: Column) -> Column:
    """The type of a part; an unknown one fails the job."""
    kind = F.coalesce(p["type"], F.lit("text"))
    return F.when(kind.isin(*TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("no such part type: "), kind)).cast("string"))


def _expanded(p: Column) -> Column:
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / PATCH_PIXELS)
    return (
        F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def format_chat(turns: DataFrame, conv="conv_id", turn="turn", role="role", parts="parts", trained_role="assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of turn, start, offset, length), attachments (number, type, ref, tokens and measures), n_turns.

    start counts code points of ``formatted``; offset those of the turn, for reading turn by turn.
    """
    kept = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.withField("type", _kind(p))).alias("parts"),
    )
    attached = lambda c: F.filter(c, lambda p: p["type"] != "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("own", F.size(attached(F.col("parts"))))
    kept = kept.withColumn("seen", F.coalesce(F.sum("own").over(before), F.lit(0))).withColumn("ord", F.row_number().over(order) - 1)

    def visit(p: Column, i: Column) -> Column:
        number = F.col("seen") + F.size(attached(F.slice("parts", F.lit(1), i + 1))) - 1
        placeholder = F.concat(F.lit("["), p["type"], F.lit(":"), number.cast("string"), F.lit("]"))
        return F.when(p["type"] == "text", escape(p["text"])).otherwise(placeholder)

    kept = kept.withColumn("content", F.array_join(F.transform("parts", visit), ""))
    kept = kept.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BEGIN)))
    kept = kept.withColumn("piece", F.concat("head", "content", F.lit(END + CLOSE)))
    kept = kept.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    listed = F.transform(attached(F.col("parts")), lambda p, i: F.struct((F.col("seen") + i).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens"), *[p[c].alias(c) for c in MEASURES]))
    loss = F.when(F.col("role") == trained_role, F.struct(
        F.col("ord").alias("turn"), (F.col("at") + F.length("head")).alias("start"), F.length("head").alias("offset"), F.length("content").alias("length")
    ))
    rows = kept.select("conv_id", F.struct("ord", "piece", loss.alias("loss"), listed.alias("listed")).alias("r"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("rs", lambda r: r["piece"]), "").alias("formatted"),
        F.array_compact(F.transform("rs", lambda r: r["loss"])).alias("loss_mask"),
        F.flatten(F.transform("rs", lambda r: r["listed"])).alias("attachments"),
        F.size("rs").cast("long").alias("n_turns"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: conv_id, turns (array of role, text, parts), loss_text. ``text`` is the text parts' text."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda t: t != "")
    role = lambda t: unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), BEGIN, 1))
    body = lambda t: F.substring_index(F.substr(t, F.lit(1) + F.instr(t, BEGIN) + len(BEGIN) - 1), END, 1)
    # texts hold no bare bracket: what starts with one is a placeholder
    runs = lambda t: F.regexp_extract_all(t, F.lit(r"\[[a-z]+:[0-9]+\]|[^\[]+"), F.lit(0))
    texts = lambda t: F.regexp_replace(t, r"\[[a-z]+:[0-9]+\]", "")

    def part(x: Column) -> Column:
        held = F.get("attachments", F.substring_index(F.substring_index(x, ":", -1), "]", 1).cast("int"))
        place = x.startswith("[")
        fields = [F.when(place, held["type"]).otherwise("text").alias("type"), F.when(~place, unescape(x)).alias("text")]
        return F.struct(*fields, *[F.when(place, held[c]).alias(c) for c in ("ref", *MEASURES)])

    turn = lambda t: F.struct(role(t).alias("role"), unescape(texts(body(t))).alias("text"), F.transform(runs(body(t)), part).alias("parts"))
    out = formatted.withColumn("pieces", pieces)
    return out.select(
        "conv_id", "formatted", F.transform("pieces", turn).alias("turns"),
        F.array_join(F.transform("loss_mask", lambda m: unescape(texts(F.substr(F.get("pieces", m["turn"]), m["offset"] + 1, m["length"])))), "").alias("loss_text"),
    )


def text_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``parts``: the text as the only part."""
    empty = "'ref', cast(null as string), 'width', cast(null as int), 'height', cast(null as int), 'seconds', cast(null as double), 'pages', cast(null as int)"
    return df.withColumn("parts", F.array(F.expr(f"named_struct('type', 'text', 'text', `{text}`, {empty})")))


CONTROL = "</s>[INST] ok [/INST]"


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the control one, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    made = format_chat(text_parts(given.unionByName(control)))
    back = read_chat(made)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op8_chat_format": op8_chat_format}
ORACLE = {
    "op8_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(20 + length(regexp_replace(role, '[\\<\[]', 'xx', 'g')) + length(regexp_replace(text, '[\\<\[]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}
