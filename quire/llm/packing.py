"""Best-fit packing: documents in as few sequences as it can, by best-two-fit on the table of lengths.

1. Tokenize.  A document is its token ids and one end id; only documents longer than a sequence are cut.
2. Count the pieces of each length: ``size`` numbers at most, whatever the corpus.
3. Plan on the counts (``plan``).  A bin takes the longest length left and then, greedily, the longest that
   still fits; its smallest piece is then replaced by the two unpacked lengths that fill the gap it leaves
   most tightly, if they fill it better.  The same bin is repeated as often as the counts allow, so the
   plan has a few bins per length and its size does not depend on the corpus either.
4. Number the pieces of each length (salted, so that a length which a third of the pieces have is spread
   over many tasks) and look up each number's bin and place in the plan.

Edge cases: a null or empty text is its end id alone.  Repeated rows and repeated ids are separate
documents.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import materialize, small_batches
from quire.llm._vector import chunks

if TYPE_CHECKING:
    from tokenizers import Tokenizer

SIZE = 4096
END = 1
SALTS = 512
#: Words whose ids a Python worker remembers, and as many from before that; words that come again stay.
REMEMBERED = 60_000
#: New words that are encoded as one text.
TOGETHER = 64
#: Documents whose ids are held at a time.
ROWS = 500
#: Bytes of text parted at a time; a word that comes again in them is looked up once.
PARTED = 1 << 20
#: What one kind of tokenizer does ahead of its model, ...
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: ... and the words that this only lower-cases and parts.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
KINDS = np.array([SPACE if c in b" \t\n\v\f\r" else OTHER if not 32 < c < 127 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SYMBOL for c in range(256)], np.uint8)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"

_known: dict[str, tuple[dict[str, bytes], dict[str, bytes], Models]] = {}


class Models(NamedTuple):
    """A tokenizer, the same for parts of ``PLAIN`` words if it is of that kind, and the tokens it finds in texts ahead of all else."""

    whole: Tokenizer
    parts: Tokenizer | None
    own: list[str]


def _models(tokenizer: str) -> Models:
    from tokenizers import Tokenizer

    # Tasks fill the cores; more threads in a task only add memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_file(tokenizer)
    of = json.loads(whole.to_str())
    before, added = (of["pre_tokenizer"] or {}).get("pretokenizers", []), of["added_tokens"]
    alike = (of["normalizer"] or {}).get("normalizers") == NORMALIZERS and len(before) == 2 and before[0] == SPLIT
    alike = alike and before[1]["type"] == "ByteLevel" and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
    alike = alike and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
    return Models(whole, _for_parts(whole, of | {"normalizer": None, "pre_tokenizer": before[1]}) if alike else None, [t["content"] for t in added])


def _for_parts(whole: Tokenizer, of: dict) -> Tokenizer:
    """The tokenizer that ``of`` describes, with the model that ``whole`` has; vocabulary and merges take as much as all else."""
    from tokenizers import Tokenizer

    parts = Tokenizer(whole.model)
    parts.pre_tokenizer = whole.pre_tokenizer[1]
    parts.add_tokens(list(whole.get_added_tokens_decoder().values()))
    return parts if parts.get_added_tokens_decoder() == whole.get_added_tokens_decoder() else Tokenizer.from_str(json.dumps(of))


def encode(texts: list[str | None] | pa.Array, tokenizer: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer never joins what white space parts, nor the parts of plain words, so each distinct one is encoded once and remembered.
    """
    if tokenizer not in _known:
        _known[tokenizer] = {}, {}, _models(tokenizer)
    models = _known[tokenizer][2]
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    out = []
    for _, _, data, offsets in chunks(texts, PARTED):
        data, at, kind = parted(data, offsets, models.parts is not None)
        words = kind != SPACE
        strings = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data))
        coded = strings.filter(pa.array(words)).dictionary_encode()
        ids = _ids(coded.dictionary.to_pylist(), tokenizer)
        number, cuts = coded.indices.to_numpy(), np.searchsorted(at[words], offsets).tolist()
        out += [b"".join([ids[k] for k in number[a:b].tolist()]) for a, b in pairwise(cuts)]
    for own in models.own:
        for k in np.flatnonzero(pc.fill_null(pc.match_substring(texts, own), False).to_numpy(zero_copy_only=False)).tolist():
            out[k] = _each([texts[k].as_py()], models.whole)[0]
    return out


def parted(data: np.ndarray, offsets: np.ndarray, alike: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and kinds of the parts of texts, white space too: plain words are parted as ``SPLIT`` does it and lower-cased, all are whole if the tokenizer isn't ``alike``."""
    n = len(data)
    kind = KINDS[data] if alike else np.where(KINDS[data] == SPACE, SPACE, OTHER)
    edge = np.zeros(n + 3, bool)
    edge[offsets] = True
    start = edge.copy()
    start[1:n] |= (kind[1:] == SPACE) != (kind[:-1] == SPACE)
    if alike:
        # Letters of two bytes; the signs of multiplication and division would be among them.
        second = np.zeros(n, bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kind[second] = LETTER
        kind[:-1][second[1:]] = LETTER
        if (kind == OTHER).any():
            word = np.cumsum(start[:n], dtype=np.int32) - 1
            whole = np.zeros(int(word[-1]) + 1, bool)
            whole[word[kind == OTHER]] = True
            kind[whole[word]] = OTHER
        letter = kind == LETTER
        data = np.where(letter, LOWER[data], data)
        data[letter & second & (data < 0x9F)] += 0x20
        start[:n] |= kind == DIGIT
        start[1:n] |= kind[1:] != kind[:-1]
        # An apostrophe that opens a part takes some letters along.
        at = np.flatnonzero((data == ord("'")) & (kind == SYMBOL) & start[:n])
        one, two = (np.where(np.append(letter, [False] * 2)[at + k] & ~edge[at + k], np.append(data, [0] * 2)[at + k], 0) for k in (1, 2))
        short = np.isin(one, list(b"stmd"))
        long = np.isin(one.astype(int) * 256 + two, [256 * a + b for a, b in (b"re", b"ve", b"ll")])
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long] + 3] = True
    at = np.flatnonzero(start[:n])
    return data, at, kind[at]


def _ids(words: list[str], tokenizer: str) -> list[bytes]:
    """Ids of each of some parts or words."""
    known, before, models = _known[tokenizer]
    if len(known) > REMEMBERED:
        known, before = {}, known
        _known[tokenizer] = known, before, models
    new = []
    for word in words:
        if word not in known:
            if (ids := before.get(word)) is None:
                new.append(word)
            else:
                known[word] = ids
    plain = [w for w in new if PLAIN.fullmatch(w)] if models.parts else []
    other = [w for w in new if not PLAIN.fullmatch(w)] if models.parts else new
    for model, those in ((models.parts, plain), (models.whole, other)):
        for at in range(0, len(those), 10_000):
            known.update(zip(those[at : at + 10_000], _ids_of(those[at : at + 10_000], model), strict=True))
    return [known[w] for w in words]


def _each(texts: list[str], model: Tokenizer) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def _ids_of(words: list[str], model: Tokenizer) -> Iterator[bytes]:
    """Ids of each word; many are encoded as one text, with a special token between them that is in none."""
    marks = {k: t.content for k, t in model.get_added_tokens_decoder().items() if t.special and not (t.single_word or t.lstrip or t.rstrip)}
    mark = max(marks, default=None)
    if mark is None or any(marks[mark] in w for w in words):
        yield from _each(words, model)
        return
    groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
    for group, ids in zip(groups, _each([marks[mark].join(g) for g in groups], model), strict=True):
        ends = np.flatnonzero(np.frombuffer(ids, np.uint32) == mark)
        assert len(ends) == len(group) - 1
        start = 0
        for end in [*(4 * ends).tolist(), len(ids)]:
            yield ids[start:end]
            start = end + 4


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenized pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    tail = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, ROWS):
                out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                keys = batch.column("doc_id").slice(at, ROWS).to_pylist()
                for key, ids in zip(keys, encode(texts.slice(at, ROWS), tokenizer), strict=True):
                    ids += tail
                    for k, start in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[start : start + 4 * size]
                        for name, value in zip(out, (key, k, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4") if keep_ids else None), strict=True):
                            out[name].append(value)
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if keep_ids else {})
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in kinds.items()], names=list(kinds))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<long>" if keep_ids else ""))


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Bins as (how many, their lengths), best-two-fit on the number of pieces of each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while (there := np.flatnonzero(left)).size:
        used = np.zeros(size + 1, dtype=np.int64)
        chosen, gap = [], size

        def take(length: int) -> None:
            used[length] += 1
            chosen.append(length)

        take(int(there[-1]))
        gap -= chosen[0]
        while gap and (fit := np.flatnonzero(left[: gap + 1] > used[: gap + 1])).size:
            take(int(fit[-1]))
            gap -= chosen[-1]
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            used[smallest] -= 1
            pair = _tightest_pair(left - used, gap + smallest)
            used[smallest] += 1
            if sum(pair) > smallest:
                used[smallest] -= 1
                chosen.pop()
                take(pair[0])
                take(pair[1])
        needed = np.flatnonzero(used)
        times = int((left[needed] // used[needed]).min())
        left -= times * used
        bins.append((times, chosen))
    return bins


def _tightest_pair(left: np.ndarray, gap: int) -> tuple[int, int]:
    """Two lengths still unpacked with the largest sum up to ``gap``."""
    there = np.flatnonzero(left[: gap + 1] > 0)
    if not there.size:
        return 0, 0
    # For each first length the largest second one that fits.
    at = np.searchsorted(there, gap - there, side="right") - 1
    alone = (at >= 0) & (there[at] == there) & (left[there] < 2)
    at = np.where(alone, at - 1, at)
    sums = np.where(at >= 0, there + there[at], 0)
    best = int(sums.argmax())
    return (int(there[best]), int(there[at[best]])) if sums[best] else (0, 0)


def lay_out(bins: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first number, bins, first bin, offset): numbers from the first on lie in consecutive bins at that offset."""
    rows: dict[int, list] = {}
    first_bin = 0
    seen: dict[int, int] = {}
    for times, lengths in bins:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((seen.get(length, 0), times, first_bin, offset))
            seen[length] = seen.get(length, 0) + times
            offset += length
        first_bin += times
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length``."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = lay_out(plan(counts, size))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_salt.select(F.col("length").alias("_l"), F.col("salt").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    numbered = numbered.join(bases, (F.col("length") == F.col("_l")) & (F.col("salt") == F.col("_s"))).withColumn("number", F.col("number") + F.col("base")).drop("_l", "_s", "base", "salt")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                here = length == one
                rows = layout[int(one)]
                row = rows[np.searchsorted(rows[:, 0], number[here], side="right") - 1]
                sequence[here] = row[:, 2] + number[here] - row[:, 0]
                offset[here] = row[:, 3]
            names = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in cut.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, tokenizer, size, end, doc_id, text))
    return pack(cut, size).withColumn("length", F.col("length").cast("long"))
