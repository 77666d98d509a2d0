"""Page numbering over ordered leaves: ordinals, labels, file prefixes, reconciliation, reordering.

``leaves``: project_id, scan (order), leaf_role, run_id, ocr_folio.  ``runs``: project_id, run_pos, run_id, style,
start_mode, start_no, step_no, lo, hi (span).  Runs are few per project; leaves are one book's, and all windows are
by project or run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import alphabetic, roman

DASH, BLANK = "—", "[Blank Page]"
#: Page type -> (leaf role, plate side).
ROLES = {"normal": ("text", None), "blank": ("blank", None), "plate_p": ("plate", "recto"), "plate_b": ("plate", "verso"), "plate_r": ("plate", "verso"), "cover": ("cover", None), "skip": ("skip", None)}


def leaf_role(page_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, (role, _) in ROLES.items():
        out = F.when(page_type == kind, role).otherwise(out)
    return out


def plate_side(page_type: Column) -> Column:
    return F.when(page_type == "plate_p", "recto").when(page_type.isin("plate_b", "plate_r"), "verso")


def ordinals(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``ordinal``, the number a leaf takes in its run; plates and leaves without a run take none.

    For runs that all set their own start, a window by run is enough.
    """
    counted = (F.col("leaf_role") != "plate") & F.col("style").isNotNull()
    at = F.count(F.when(counted, 1)).over(Window.partitionBy("project_id", "run_id").orderBy("scan")) - 1
    known = runs.select("project_id", "run_id", "style", "start_no", "step_no")
    return leaves.join(known, ["project_id", "run_id"], "left").withColumn("ordinal", F.when(counted, F.col("start_no") + at * F.col("step_no")).cast("int"))


def ordinals_with_continue(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """As ``ordinals``, for runs that may continue the run before them.

    A continued run starts after the last number of the nearest earlier declared run that has one at that leaf, so
    each project's leaves are read in order, once; a task holds the count and last number of each of the project's runs.
    """
    declared = runs.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("run_pos", "run_id", "style", "start_mode", "start_no", "step_no"))).alias("runs"))
    rows = leaves.select("project_id", "scan", "leaf_role", "run_id").join(declared, "project_id").repartition("project_id").sortWithinPartitions("project_id", "scan", "leaf_role", "run_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, count, last = None, [], []
        for batch in batches:
            out = []
            for at, scan, role, run_id, known in zip(*(batch.column(c).to_pylist() for c in ("project_id", "scan", "leaf_role", "run_id", "runs")), strict=True):
                if at != project:
                    project, count, last = at, [0] * len(known), [None] * len(known)
                k = next((i for i, r in enumerate(known) if run_id is not None and r["run_id"] == run_id), None)
                if k is None or role is None or role == "plate":
                    continue
                run, start = known[k], known[k]["start_no"]
                if run["start_mode"] != "set":
                    earlier = [n for n, r in zip(last[:k], known, strict=False) if n is not None and r["style"] not in (None, "none")]
                    start = earlier[-1] + run["step_no"] if earlier and run["step_no"] is not None else start
                n = None if start is None or run["step_no"] is None else start + count[k] * run["step_no"]
                count[k], last[k] = count[k] + 1, n
                out.append((at, scan, n))
            columns = zip(*out, strict=True) if out else ([], [], [])
            kinds = (batch.schema.field("project_id").type, batch.schema.field("scan").type, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["project_id", "scan", "ordinal"])

    kind = {c: leaves.schema[c].dataType.simpleString() for c in ("project_id", "scan")}
    found = rows.mapInArrow(number, f"project_id {kind['project_id']}, scan {kind['scan']}, ordinal int")
    return leaves.join(found, ["project_id", "scan"], "left").join(runs.select("project_id", "run_id", "style"), ["project_id", "run_id"], "left")


def label() -> Column:
    """Display label from leaf_role, style and ordinal."""
    n, style = F.col("ordinal"), F.col("style")
    shown = (
        F.when(style == "roman-lower", roman(n)).when(style == "roman-upper", F.upper(roman(n))).when(style == "arabic", n.cast("string")).when(style == "alpha", alphabetic(n)).when(style == "none", DASH)
    )
    return F.when(F.col("leaf_role") == "plate", DASH).when(style.isNull(), F.when(F.col("leaf_role") == "blank", BLANK).otherwise("")).otherwise(shown)


def labels(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    return ordinals(leaves, runs).withColumn("label", label())


def reconcile(labelled: DataFrame) -> DataFrame:
    """Adds ``duplicate`` and ``out_of_sequence``; unnumbered leaves are never flagged."""
    real = ~F.col("label").isin("", DASH, BLANK)
    first = F.row_number().over(Window.partitionBy("project_id", "label").orderBy("scan"))
    return labelled.withColumn("duplicate", real & (first > 1)).withColumn("out_of_sequence", real & F.col("ocr_folio").isNotNull() & (F.col("ocr_folio") != F.col("label")))


def proof_start(leaves: DataFrame) -> DataFrame:
    """First scan in the proof by project."""
    inside = F.col("leaf_role").isin("cover", "plate", "blank") | F.col("run_id").isNotNull()
    return leaves.groupBy("project_id").agg(F.min(F.when(inside, F.col("scan"))).alias("proof_start"), F.max("scan").alias("max_scan"))


def prefixes(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``seq_width``, ``section``, ``prefix`` (null: not in the package)."""
    front = runs.groupBy("project_id").agg(F.min_by(F.struct("lo", "hi"), F.struct("lo", "run_pos")).alias("front"))
    numbered = ordinals(leaves, runs).join(proof_start(leaves), "project_id").join(front, "project_id", "left")
    width = F.when(F.col("max_scan") - F.col("proof_start") + 1 > 999, 4).otherwise(3)
    numbered = numbered.withColumn("seq_width", width).withColumn("section", F.when(F.col("scan").between(F.col("front.lo"), F.col("front.hi")), "f").otherwise("p"))
    at = F.col("scan") - F.col("proof_start")
    seq = F.when(F.col("seq_width") == 4, F.format_string("%04d", at)).otherwise(F.format_string("%03d", at))
    role = F.col("leaf_role")
    suffix = F.when(F.col("page_type") == "plate_p", "p").when(F.col("page_type") == "plate_r", "r").otherwise("b") if "page_type" in leaves.columns else F.lit("b")
    prefix = (
        F.when(role == "skip", None)
        .when(role == "cover", F.concat(seq, F.lit("e")))
        .when(role == "plate", F.concat(seq, F.col("section"), suffix))
        .when(F.col("ordinal").isNotNull(), F.concat(seq, F.col("section"), F.format_string("%03d", F.col("ordinal"))))
    )
    return numbered.withColumn("prefix", prefix).drop("front")


def manifest(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds label, prefix and ``export_name``, the running number of the leaves in the package."""
    order = Window.partitionBy("project_id").orderBy("scan")
    named = prefixes(leaves, runs).withColumn("label", label())
    at, total = F.count("prefix").over(order), F.count("prefix").over(Window.partitionBy("project_id"))
    return named.withColumn("export_name", F.when(F.col("prefix").isNotNull(), F.when(total > 999, F.format_string("%04d", at - 1)).otherwise(F.format_string("%03d", at - 1))))


def default_runs(leaves: DataFrame) -> DataFrame:
    """One arabic run over all numbered leaves of projects that have none."""
    return leaves.groupBy("project_id").agg(F.min("scan").alias("lo"), F.max("scan").alias("hi")).select(
        "project_id", F.lit(0).alias("run_pos"), F.lit("body").alias("run_id"), F.lit("arabic").alias("style"), F.lit("set").alias("start_mode"), F.lit(1).alias("start_no"), F.lit(1).alias("step_no"), "lo", "hi"
    )


def seed_runs(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Leaf role and run of pages from inclusive front and body ranges; ``ranges``: project_id, front_lo, front_hi, body_lo, body_hi."""
    out = pages.join(ranges, "project_id", "left").withColumn("leaf_role", leaf_role(F.col("page_type"))).withColumn("side", plate_side(F.col("page_type")))
    run = F.when(F.col("idx0").between(F.col("front_lo"), F.col("front_hi")), "front").when(F.col("idx0").between(F.col("body_lo"), F.col("body_hi")), "body")
    return out.withColumn("run_id", F.when(F.col("leaf_role").isin("text", "blank"), run)).drop("front_lo", "front_hi", "body_lo", "body_hi")


def reorder(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages in a new order; ``order``: project_id, idx0, position.  Everything else stays with its page."""
    moved = order.select("project_id", "idx0", F.col("position").alias("new_idx0"))
    return pages.join(moved, ["project_id", "idx0"]).withColumn("old_idx0", F.col("idx0")).withColumn("idx0", F.col("new_idx0").cast("int")).drop("new_idx0")


def insert_page(pages: DataFrame, inserted: DataFrame) -> DataFrame:
    """Pages at or after the place move back by one; ``inserted``: project_id, at_idx0, doc_id, page_type."""
    at = inserted.select("project_id", F.col("at_idx0").alias("_at"))
    moved = pages.join(at, "project_id", "left").withColumn("idx0", (F.col("idx0") + F.when(F.col("idx0") >= F.col("_at"), 1).otherwise(0)).cast("int")).drop("_at")
    new = inserted.select("project_id", F.col("at_idx0").cast("int").alias("idx0"), *[c for c in pages.columns if c not in ("project_id", "idx0")])
    return moved.unionByName(new.select(*moved.columns))


def shift_spans(runs: DataFrame, inserted: DataFrame) -> DataFrame:
    """Spans after an insertion: an end at or after it and a start after it move by one."""
    at = inserted.select("project_id", F.col("at_idx0").alias("_at"))
    plus = lambda c, moves: (F.col(c) + F.when(moves, 1).otherwise(0)).cast("int").alias(c)
    joined = runs.join(at, "project_id", "left")
    return joined.select(*[c for c in runs.columns if c not in ("lo", "hi")], plus("lo", F.col("lo") > F.col("_at")), plus("hi", F.col("hi") >= F.col("_at")))


def gaps(numbers: DataFrame, by: str, number: str) -> DataFrame:
    """Places where consecutive numbers of a group differ by more than one."""
    before = F.lag(number).over(Window.partitionBy(by).orderBy(number))
    return numbers.withColumn("before", before).where(F.col(number) - F.col("before") > 1).select(by, "before", F.col(number).alias("after"), (F.col(number) - F.col("before") - 1).alias("missing"))


def move_selection(leaves: DataFrame, moves: DataFrame) -> DataFrame:
    """New ``position`` of each scan after the ``selected`` ones were moved before or after a target scan of their project.

    ``leaves``: project_id, scan, position, selected; ``moves``: one row per project: target, after.  Without a move
    nothing changes; a target that isn't there, or is selected itself, sends the selection to the end.
    """
    rest = leaves.where("not selected").select("project_id", F.col("scan").alias("target"), F.col("position").alias("_at"))
    to = moves.join(rest, ["project_id", "target"], "left").select("project_id", "after", "_at", F.lit(True).alias("_move"))
    moving = F.col("selected") & F.coalesce("_move", F.lit(False))
    place = F.when(moving, F.coalesce("_at", F.lit(2**31 - 1))).otherwise(F.col("position"))
    side = F.when(moving, F.when(F.col("after"), 2).otherwise(0)).otherwise(1)
    order = Window.partitionBy("project_id").orderBy("_place", "_side", "_old")
    out = leaves.join(to, "project_id", "left").select("project_id", "scan", place.alias("_place"), side.alias("_side"), F.col("position").alias("_old"))
    return out.select("project_id", "scan", (F.row_number().over(order) - 1).alias("position"))
