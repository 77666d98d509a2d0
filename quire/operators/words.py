"""OCR words: flags, decisions, low confidence, lines rebuilt from boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are usually recognition errors.
BAD_WORDS = ("teh", "adn", "nw", "ot", "fi", "ii", "llie", "llis", "thc", "ihe", "thf", "thg", "tbi", "tbis", "tbat", "tbey", "wbat", "wbich", "ibe", "tins", "bim", "bave", "bead", "bee")
LOW_CONFIDENCE = 0.5


def flagged(words: DataFrame, bad: Sequence[str] = BAD_WORDS, good: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Words on the bad list and not on the good one; deleted words are flagged too.  ``good``: word."""
    out = words.where(F.col(text).isin(*bad))
    return out if good is None else out.join(good.select(F.col("word").alias(text)).distinct(), text, "left_anti")


def low_confidence(words: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    return words.where(~F.coalesce("deleted", F.lit(False)) & (F.col("confidence") < below))


def decided(flags: DataFrame, decisions: DataFrame, key: str = "word_id", order: str = "seq") -> DataFrame:
    """Flags with their status: the last decision, or open."""
    last = decisions.groupBy(key).agg(F.max_by("decision", order).alias("decision"))
    return flags.join(last, key, "left").withColumn("status", F.coalesce("decision", F.lit("open"))).drop("decision")


def _rebuilt(keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Text of each page from batches of its words in order of middle and left: the key's columns, middle, left, height, text."""

    def shown(words: list[tuple]) -> str:
        # Stable, so words with equal left edges stay in order; those without one come first.
        return " ".join(text for _, text in sorted(words, key=lambda w: (w[0] is not None, w[0])) if text is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, schema, done = None, None, []
        lines, words, low, at = [], [], None, None

        def close() -> None:
            done.append((*page, "\n".join([*lines, shown(words)])))

        def batch_of() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            if schema is None:
                schema = pa.schema([*(batch.schema.field(k) for k in range(keys)), pa.field("page_text", pa.string())])
            columns = [c.to_pylist() for c in batch.columns]
            for key, mid, left, height, text in zip(zip(*columns[:keys], strict=True), *columns[keys:], strict=True):
                if key != page:
                    if page is not None:
                        close()
                    page, lines, words, low, at = key, [], [(left, text)], height, mid
                    continue
                least = min((h for h in (low, height) if h is not None), default=0)
                if mid is not None and at is not None and abs(mid - at) <= max(1.0, least / 2.0):
                    words.append((left, text))
                    if height is not None and low is not None and height < low:
                        low, at = height, mid
                else:
                    lines.append(shown(words))
                    words, low, at = [(left, text)], height, mid
            yield batch_of()
        if page is not None:
            close()
            yield batch_of()

    return run


def page_text(words: DataFrame, key: Sequence[str] = ("project_id", "idx0")) -> DataFrame:
    """Text of every page from its words that aren't deleted (left, top, width, height, text), lines by the middle of each word.

    Words in order of middle and left join the line whose smallest word's middle is within half that word's height
    (at least 1); a line's words are then put in order of their left edges.  Pages are read off words in that order,
    each word once; a task holds the text of the page that it is at.
    """
    kept = words.where(~F.coalesce("deleted", F.lit(False))).withColumn("mid", F.col("top") + F.col("height") / 2.0)
    ordered = kept.repartition(*key).sortWithinPartitions(*key, "mid", "left", "word_id", "top", "width", "height", "text")
    kinds = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in key)
    return ordered.select(*key, "mid", "left", "height", "text").mapInArrow(_rebuilt(len(key)), f"{kinds}, page_text string")


def open_counts(flags: DataFrame, by: Sequence[str]) -> DataFrame:
    """Flags that nobody has decided on, and all flags; ``flags`` as ``decided`` gives them."""
    return flags.groupBy(*by).agg(F.count_if(F.col("status") == "open").alias("open"), F.count("*").alias("flags"))
