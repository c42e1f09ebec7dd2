"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context and only its reply is trainable. A conversation whose last turn is not
the assistant's (or that has none of the assistant) also gives one row without a
target, so that no turn is lost.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
texts and roles each backslash is doubled and ``<|`` becomes ``<\\|``; a line
break in a role becomes ``<\\n|``. Markers then stand nowhere else, and
:func:`unescape` gives the text back.

Defined results: null text or role is empty; rows of one conversation are
ordered by turn (null first), then role and text; repeated rows are turns of
their own; a null conversation id is a conversation of its own. Extra columns
are ignored. The examples of a conversation of n turns hold its text up to n
times: that is the operator's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    # After escape() a single backslash never stands between "<" and "n".
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text",
                    target_role: str = "assistant") -> DataFrame:
    """One row per example: ``conv_id, example, formatted, loss_start, loss_chars``.

    ``example`` counts from 1 inside a conversation. ``formatted`` is the whole
    marked-up text; its code points ``[loss_start, loss_start + loss_chars)`` are
    trainable (``loss_start`` null and no characters without a target).
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shown = escape(text)
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                 F.concat(F.lit(START), _escape_role(role), F.lit("\n"), shown, F.lit(END)).alias("seg"),
                 F.length(shown).alias("n")).alias("t"))
    convs = (rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
             .select("conv_id", F.col("ts.seg").alias("segs"), F.col("ts.n").alias("ns"),
                     F.transform("ts", lambda t: t["role"] == target_role).alias("is_target")))
    ends = F.filter(F.sequence(F.lit(1), F.size("segs")),
                    lambda i: F.element_at("is_target", i) | (i == F.size("segs")))
    prefix = F.array_join(F.slice("segs", 1, F.col("last")), "")
    target = F.element_at("is_target", F.col("last"))
    n = F.element_at("ns", F.col("last"))
    return (convs.select("conv_id", "segs", "ns", "is_target", F.posexplode(ends).alias("example", "last"))
            .select("conv_id", (F.col("example") + 1).alias("example"), prefix.alias("formatted"),
                    target.alias("has_target"), n.alias("n"))
            .select("conv_id", "example", "formatted",
                    F.when(F.col("has_target"),
                           F.length("formatted") - len(END) - F.col("n")).alias("loss_start"),
                    F.when(F.col("has_target"), F.col("n")).otherwise(0).alias("loss_chars")))


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return F.when(start.isNull(), "").otherwise(unescape(F.substring(formatted, start + 1, chars)))


def parse_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted example."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.lit(2**31 - 2))

    def turn(part: Column) -> Column:
        cut = F.instr(part, "\n")
        body = F.substring(part, cut + 1, F.length(part) - cut - len(END))
        return F.struct(_unescape_role(F.substring(part, F.lit(1), cut - 1)).alias("role"),
                        unescape(body).alias("text"))

    return F.transform(parts, turn)


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what the examples say when they are read back."""
    read = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"), "formatted",
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"))
    whole = (read.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))),
                                 lambda x: x["loss"]), "").alias("loss"))
        .withColumn("turns", parse_turns(F.col("longest"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars")
