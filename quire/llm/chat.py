r"""Chat formatting by prefix-target expansion.

A turn becomes ``<|im_start|>role\ntext<|im_end|>\n``.  Inside roles and texts every ``<``, any number of
``\``, ``|`` gets one more ``\``, so that no marker can appear in them; taking one ``\`` away restores the
text.  ``format_chat`` gives a conversation's formatted text and its examples: for each assistant turn the
text of all turns up to and including it, with the code points of the reply itself as the only trainable
span.  ``expand`` makes each example a row.  ``read_back`` gets turns and trainable texts out of the output.

Edge cases: null texts and roles are empty; turns with the same number are ordered by role and text; null
ids form one conversation; a conversation without assistant turn has no example; an empty table gives no
row.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1\|")


def _escape_role(role: Column) -> Column:
    """A role is read up to the first line feed, so its own are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_chat(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``examples`` (turn_index, text, loss_start, loss_end)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    part = lambda t: F.struct((t["role"] == "assistant").alias("reply"), head(t).alias("head"), escape(t["text"]).alias("body"))
    parts = grouped.select("conv_id", F.transform("turns", part).alias("parts"))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))
    parts = parts.select("conv_id", "parts", F.transform("parts", whole).alias("done"))
    # Where a turn ends in the formatted text, from running sums over the turns of one conversation.
    ends = F.aggregate("done", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    parts = parts.select("conv_id", "parts", F.array_join("done", "").alias("formatted"), ends.alias("ends"))

    def example(p: Column, i: Column) -> Column:
        start = F.get(F.col("ends"), i) + F.length(p["head"])
        return F.when(
            p["reply"],
            F.struct(
                i.alias("turn_index"),
                F.substring(F.col("formatted"), F.lit(1), F.get(F.col("ends"), i + 1)).alias("text"),
                start.alias("loss_start"),
                (start + F.length(p["body"])).alias("loss_end"),
            ),
        )

    return parts.select("conv_id", "formatted", F.array_compact(F.transform("parts", example)).alias("examples"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row per example of ``format_chat``."""
    return formatted.select("conv_id", F.explode("examples").alias("e")).select("conv_id", "e.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) read from the formatted text and, by example, the text under its loss mask."""
    blocks = F.split(F.col("formatted"), r"<\|im_start\|>", -1)
    body = lambda b: F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b) - F.length(F.substring_index(b, "\n", 1)) - len(END + "\n") - 1)
    turn = lambda b: F.struct(_unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(body(b)).alias("text"))
    loss = lambda e: unescape(F.substring(e["text"], e["loss_start"] + 1, e["loss_end"] - e["loss_start"]))
    return formatted.select(
        "conv_id",
        F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), turn).alias("turns"),
        F.transform("examples", loss).alias("losses"),
        F.aggregate("examples", F.lit(0).cast("long"), lambda a, e: a + F.length(e["text"])).alias("formatted_chars"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns, digests of all turns and of the trainable text, and characters of all examples."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(formatted).select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("all"), F.array_join("losses", "").alias("loss"), "formatted_chars")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        "conv_id", "n_turns", sha("all").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), "formatted_chars"
    )
