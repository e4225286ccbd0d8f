r"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A conversation becomes one transcript.  A turn is rendered as

    ### <role>\n<text></turn>\n

with the control strings inside roles and texts escaped: ``\`` as ``\b``,
``</turn>`` as ``\e``, ``### `` as ``\h`` and, in roles only, a line feed as
``\n``.  The escapes are read back in the reverse order, so any text survives.

Every assistant turn becomes one example: the context is the transcript up to
its text, the target is its escaped text.  An example stores the context as
its length in the shared transcript (``context_chars``) beside the target, so
a conversation of T turns takes O(its text) and not O(T times its text);
``with_contexts`` copies the contexts out where a trainer wants them.

Edge cases: null roles and texts are empty; turns are ordered by (turn, role,
text) with null turns first, so ties and repeated rows have a fixed order and
each row is a turn; null conversation ids form one conversation; a
conversation without an assistant turn has no examples and an empty loss.
A conversation is put together in one row, as its digest over all turns asks;
its size is bounded by Spark's 2 GB for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
#: (plain, escaped), applied in this order and undone in reverse.
_ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("### ", "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, ("\n", "\\n"))


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = _ESCAPES) -> Column:
    for plain, escaped in pairs:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...] = _ESCAPES) -> Column:
    for plain, escaped in reversed(pairs):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def transcripts(turns: DataFrame) -> DataFrame:
    """``(conv_id, transcript)`` from rows ``(conv_id, turn, role, text)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("row"))
    rendered = F.transform(
        F.array_sort(F.collect_list("row")),
        lambda r: F.concat(F.lit(OPEN), escape(r["role"], _ROLE_ESCAPES), F.lit("\n"), escape(r["text"]), F.lit(CLOSE)),
    )
    return rows.groupBy("conv_id").agg(rendered.alias("parts")).select("conv_id", F.array_join("parts", "").alias("transcript"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Transcripts of all conversations, ``(conv_id, transcript)``."""
    return transcripts(turns)


def read_turns(formatted: DataFrame) -> DataFrame:
    """Read transcripts back: one row per turn.

    ``turn_no`` from 0, unescaped ``role`` and ``text``, the escaped ``body``
    and ``body_at``, its offset in the transcript in code points.
    """
    pieces = formatted.select("conv_id", F.length("transcript").alias("chars"), F.posexplode(F.split("transcript", CLOSE)).alias("turn_no", "piece")).where("piece <> ''")
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece") + len(CLOSE)).over(before), F.lit(0))
    cut = F.instr("piece", "\n")
    body = F.substr(F.col("piece"), cut + 1)
    return pieces.select(
        "conv_id",
        "chars",
        F.col("turn_no").cast("long").alias("turn_no"),
        unescape(F.substr(F.col("piece"), F.lit(len(OPEN) + 1), cut - len(OPEN) - 1), _ROLE_ESCAPES).alias("role"),
        unescape(body).alias("text"),
        body.alias("body"),
        (at + cut).cast("long").alias("body_at"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, turn_no, context_chars, target``.

    The context is the first ``context_chars`` code points of the transcript;
    only ``target`` is under the loss mask.
    """
    return (
        read_turns(formatted)
        .where(F.col("role") == "assistant")
        .select("conv_id", "turn_no", F.col("body_at").alias("context_chars"), F.col("body").alias("target"))
    )


def with_contexts(formatted: DataFrame) -> DataFrame:
    """Examples with their contexts copied out as ``context`` (T times the text)."""
    return (
        examples(formatted)
        .alias("e")
        .join(formatted.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")))
        .select("e.*", F.substr(F.col("f.transcript"), F.lit(1), F.col("e.context_chars").cast("int")).alias("context"))
    )


def cuts(formatted: DataFrame) -> DataFrame:
    """The transcripts cut at the headers of assistant turns: ``conv_id, cut_no, cut_at, rest``.

    Cut 0 is what stands before the first header.  ``cut_at`` is where ``rest`` begins in the
    transcript, so that of cut n is the length of the n-th example's context.
    """
    header = f"{OPEN}assistant\n"
    pieces = formatted.select("conv_id", F.posexplode(F.split("transcript", header)).alias("cut_no", "rest"))
    before = Window.partitionBy("conv_id").orderBy("cut_no").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("rest") + len(header)).over(before), F.lit(0))
    return pieces.select("conv_id", F.col("cut_no").cast("long").alias("cut_no"), at.cast("long").alias("cut_at"), "rest")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted output holds, read back and digested per conversation.

    The loss is that of the expanded ``examples``: each target is read back from the transcript
    where its context ends.  A context that does not end there fails the query.
    """
    whole = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    said = read_turns(formatted).select("conv_id", F.struct("turn_no", whole.alias("s")).alias("turn"))
    expanded = examples(formatted).select("conv_id", F.struct("turn_no", "context_chars", "target").alias("example"))
    found = cuts(formatted).select("conv_id", F.struct("cut_no", "cut_at", "rest").alias("cut"))
    rows = said.unionByName(expanded, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    per = rows.groupBy("conv_id").agg(*[F.array_sort(F.collect_list(c)).alias(f"{c}s") for c in ("turn", "example", "cut")])
    glued = lambda parts: F.array_join(parts, "")
    read_back = F.zip_with(
        "examples",
        F.slice("cuts", F.lit(2), F.size("cuts")),
        lambda e, c: F.when(
            (e["context_chars"] == c["cut_at"]) & F.startswith(c["rest"], F.concat(e["target"], F.lit(CLOSE))),
            unescape(F.substr(c["rest"], F.lit(1), F.length(e["target"]))),
        ).otherwise(F.raise_error(F.lit("the context of an example does not end at its target")).cast("string")),
    )
    last = F.element_at("cuts", -1)
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        glued(F.transform("turns", lambda r: r["s"])).alias("turns"),
        glued(read_back).alias("loss"),
        (last["cut_at"] + F.length(last["rest"])).alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
