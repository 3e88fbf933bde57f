"""Chat formatting (operator 10): typed content parts.

A turn is a list of parts (kind, text, uri, width, height, seconds, pages).
``visit`` turns each part into what stands in the prompt: escaped text, or a
placeholder ``<|image:t.p|>`` (turn and part number, so placeholders are
ordered and unique) with the attachment's reference and the tokens that it
expands to.  Turns are marked ``<|turn:ROLE|>`` ... ``<|end|>``.  Inside
roles and texts a backslash is doubled and ``<|`` and ``|>`` get a backslash
between their characters, so a marker never comes from a text and
``unescaped`` gives the text back.

DataFrame functions only.

Cases: a null or empty text is an empty turn; texts of any length are taken whole; a null role is the empty role;
null parts are skipped; turns are ordered by number (null first), then role
and text; repeated rows are repeated turns; a null conv_id is a conversation
of its own; an empty table gives an empty result; other columns are not read.
One conversation is one row of the result by its nature, so the turns of one
conversation meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
PATCH = 28  # pixels of an image side per token
AUDIO_TOKENS = 25  # per second
PAGE_TOKENS = 256  # per document page


def escaped(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def unescaped(c: Column) -> Column:
    """A single backslash between the two characters was put there; all
    others are pairs."""
    parts = F.replace(F.replace(c, F.lit("|\\>"), F.lit("|>")), F.lit("<\\|"), F.lit("<|"))
    return F.replace(parts, F.lit("\\\\"), F.lit("\\"))


def text_part(c: Column) -> Column:
    """A list of one text part."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), null("string").alias("uri"), null("int").alias("width"),
                            null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def visit(part: Column, turn: Column, number: Column) -> Column:
    """One part as (shown, kind, uri, tokens); tokens are those of an
    attachment's expansion."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(PATCH)), F.lit(1)) / F.lit(PATCH))
    tokens = F.when(part["kind"] == "image", side("width") * side("height")) \
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS)) \
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS).otherwise(F.lit(0)).cast("long")
    is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
    marker = F.concat(F.lit("<|"), escaped(part["kind"]), F.lit(":"), turn.cast("string"), F.lit("."), number.cast("string"), F.lit("|>"))
    shown = F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise(marker)
    return F.struct(shown.alias("shown"), F.when(~is_text, part["kind"]).alias("kind"), F.when(~is_text, part["uri"]).alias("uri"), tokens.alias("tokens"))


def _body(parts: str, seen: str) -> Column:
    """What stands in a turn.  Text parts that follow one another are escaped
    as one text: a marker could come from where they meet."""
    begin = F.struct(F.lit("").alias("out"), F.lit("").alias("open"))

    def step(state: Column, x: Column) -> Column:
        is_text = x["seen"]["kind"].isNull()
        text = F.coalesce(x["part"]["text"], F.lit(""))
        return F.struct(F.when(is_text, state["out"]).otherwise(F.concat(state["out"], escaped(state["open"]), x["seen"]["shown"])).alias("out"),
                        F.when(is_text, F.concat(state["open"], text)).otherwise(F.lit("")).alias("open"))

    pairs = F.arrays_zip(F.col(parts).alias("part"), F.col(seen).alias("seen"))
    return F.aggregate(pairs, begin, step, lambda state: F.concat(state["out"], escaped(state["open"])))


def formatted(turns: DataFrame, parts_col: str = "parts", conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role", loss_role: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, n_turns, loss_spans (start and
    length in code points of the bodies of ``loss_role``), attachments (turn,
    kind, uri, tokens) and attachment_tokens."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.filter(F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"))
    rows = rows.withColumn("order", F.struct("turn", "role", F.to_json("parts").alias("text")))
    place = Window.partitionBy("conv_id").orderBy("order")
    rows = rows.withColumn("number", F.row_number().over(place) - 1)
    rows = rows.withColumn("seen", F.transform("parts", lambda p, k: visit(p, F.col("number"), k)))
    head = F.concat(F.lit("<|turn:"), escaped(F.col("role")), F.lit("|>\n"))
    rows = rows.select("conv_id", "number", "role", head.alias("head"), _body("parts", "seen").alias("body"),
                       F.filter("seen", lambda s: s["kind"].isNotNull()).alias("attached"))
    rows = rows.withColumn("shown", F.concat("head", "body", F.lit("<|end|>\n")))
    before = Window.partitionBy("conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("shown")).over(before), F.lit(0)) + F.char_length("head")
    rows = rows.withColumn("span", F.when(F.col("role") == loss_role, F.struct(start.cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))))
    held = F.array_sort(F.collect_list(F.struct("number", "shown", "span", "attached")))
    out = rows.groupBy("conv_id").agg(held.alias("held"))
    attachments = F.flatten(F.transform("held", lambda h: F.transform(h["attached"], lambda a: F.struct(
        h["number"].alias("turn"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    out = out.select("conv_id", F.array_join(F.col("held.shown"), "").alias("formatted"), F.size("held").cast("long").alias("n_turns"),
                     F.filter(F.col("held.span"), lambda s: s.isNotNull()).alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda t, a: t + a["tokens"]))


def parsed(c: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(c, r"<\|turn:"), lambda p, k: k > 0)
    end = F.lit("<|end|>\n")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(p, "|>\n", 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, "|>\n") + 3, F.char_length(p) - F.instr(p, "|>\n") - 2 - F.char_length(end))).alias("text")))


def loss_text(c: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(c, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def probe_turns(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that look like control strings."""
    text = F.lit("\\### Assistant: </turn> ok")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Formats text conversations and returns what is read back from the
    output, per conversation."""
    rows = turns.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    out = formatted(rows)
    back = parsed(F.col("formatted"))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))
