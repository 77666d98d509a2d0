"""Read models of pages: filtered lists, records, crop rows, artifacts, naming reports, manifests of several versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import name_errors, page_id
from quire.operators import checks, listing

#: The file extension of each output type, and the first file of those that are several files.
EXTENSIONS = {"image_bytes": "png", "image": "png", "gray": "png", "binary": "png", "jpeg_bytes": "jpg", "text": "txt", "page_attrs": "json", "illustration_regions": "json", "bbox": "json", "zone_json": "json"}
PRIMARY = {"words+text": "words.json", "hi_res_crops": "crops.json", "text+attestation": "output.txt"}
#: What a naming rule says of a file.
LONGEST, ALLOWED = 8, "['.jpg', '.png', '.txt']"
MANIFEST_VERSION = 2


def filtered(pages: DataFrame, page_type: str | None = None, has_splits: bool | None = None, status: str | None = None, review_needed: bool | None = None) -> DataFrame:
    """Pages that pass all filters given; ``pages``: page_type, splits, processing_status, outputs (status, error)."""
    if page_type is not None:
        pages = pages.where(F.col("page_type") == page_type)
    if has_splits is not None:
        pages = pages.where((F.coalesce(F.size("splits"), F.lit(0)) > 0) == has_splits)
    if status is not None:
        pages = pages.where(F.col("processing_status") == status)
    if review_needed is not None:
        failed = F.when(F.col("processing_status") == "error", "error")
        pages = pages.where(F.coalesce(listing.needs_review(failed, F.col("outputs")), F.lit(False)) == review_needed)
    return pages


def split_sources(pages: DataFrame) -> DataFrame:
    return pages.where(F.size("splits") > 0)


def in_order(pages: DataFrame) -> DataFrame:
    """Ids of the pages that stages run on, the ignored ones left out."""
    return pages.where(~F.coalesce("ignore", F.lit(False))).select("project_id", page_id(F.col("idx0")).alias("page_id"))


def page_counts(pages: DataFrame) -> DataFrame:
    """By project: pages, and those for the proof."""
    return pages.groupBy("project_id").agg(F.count("*").alias("page_count"), F.count_if(~F.coalesce("ignore", F.lit(False))).alias("proof_page_count"))


def of_stage(pages: DataFrame, states: DataFrame, key: Sequence[Column]) -> DataFrame:
    """Each page (project_id, idx0, ...) with its row of ``states`` (project_id, page_id, ...; one a page): that of the first of its keys that has one.

    One join, by all keys of a page, and the nearest one kept; no key has more rows than the page has keys.
    """
    kept = [c for c in states.columns if c not in ("project_id", "page_id")]
    each = pages.select("project_id", "idx0", F.posexplode(F.array(*key)).alias("_k", "page_id")).where("page_id is not null")
    found = each.join(states, ["project_id", "page_id"]).groupBy("project_id", "idx0").agg(F.min_by(F.struct(*kept), "_k").alias("_s"))
    return pages.join(found, ["project_id", "idx0"], "left").select(*pages.columns, *(F.col(f"_s.{c}").alias(c) for c in kept))


def crop_rows(pages: DataFrame, states: DataFrame, stage: str) -> DataFrame:
    """A row a page of a stage's crop grid: page_id, n, thumb_url, flags, bbox.

    ``pages``: project_id, idx0, prefix, source_crop_bbox; ``states``: project_id, page_id, stage, status.  A page's state is kept
    under its prefix, or under its number.
    """
    number = page_id(F.col("idx0"))
    name = F.when(F.coalesce("prefix", F.lit("")) != "", F.col("prefix")).otherwise(number)
    own = pages.withColumn("_name", name)
    found = of_stage(own, states.where(F.col("stage") == stage).select("project_id", "page_id", "status"), [F.col("_name"), number])
    flags = F.array_compact(F.array(F.when(F.col("status") == "failed", "error").when(F.col("status") == "dirty", "stale")))
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("idx0")) - 1
    url = F.concat(F.lit("/api/data/projects/"), "project_id", F.lit("/pages/"), "_name", F.lit(f"/stages/{stage}/thumbnail"))
    return found.select("project_id", F.col("_name").alias("page_id"), n.alias("n"), url.alias("thumb_url"), flags.alias("flags"), F.col("source_crop_bbox").alias("bbox"))


#: A page record's fields in order; keys of images aren't kept with the page.
RECORD = (
    "project_id", "idx0", "prefix", "source_stem", "ignore", "manual_ignore", "page_type", "page_role", "leaf_role", "run_id", "label_override", "plate_tag", "plate_side", "ocr_folio", "alignment", "config_overrides",
    "splits", "illustration_regions", "source_key", "thumbnail_key", "processing_status", "processing_job_id", "processing_error", "last_processed_at", "outputs", "parent_page_id", "source_crop_bbox", "split_index",
    "split_at_stage", "split_suffix", "reading_order",
)


def records(extensions: DataFrame) -> DataFrame:
    """Page records from what is stored of pages; fields that aren't stored are null, others are left out."""
    stored = set(extensions.columns) - {"source_key", "thumbnail_key"}
    return extensions.select(*(F.col(c) if c in stored else F.lit(None).cast("string").alias(c) for c in RECORD))


def artifact_file(output_type: Column) -> tuple[Column, Column]:
    """(the first file of a stage's output, the error of a type that has none)."""
    table = F.create_map(*[F.lit(x) for k, v in ({k: f"output.{v}" for k, v in EXTENSIONS.items()} | PRIMARY).items() for x in (k, v)])
    name = table[F.coalesce(output_type, F.lit(""))]
    return name, F.when(name.isNull(), F.concat(F.lit("no extension for output type "), F.coalesce(output_type, F.lit("null"))))


def key_error(project_id: Column, key: Column) -> Column:
    """What is wrong with a storage key that isn't under its project's folder."""
    inside = F.startswith(F.regexp_replace(key, "^/+", ""), F.concat(F.lit("projects/"), project_id, F.lit("/")))
    return F.when(~F.coalesce(inside, F.lit(False)), F.concat(F.lit("key must be under projects/"), project_id, F.lit("/; got: "), F.coalesce(key, F.lit("null"))))


def queued(jobs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` queued jobs, oldest first; ``jobs``: job_id, status, created."""
    return jobs.where("status = 'queued'").orderBy("created", "job_id").limit(n)


def with_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Each item of a batch with the result at its place; ``items``: job_id, items (array), ``results``: job_id, results (array).

    A batch whose results are fewer or more than its items is an error, told by ``error``.
    """
    both = items.join(results, "job_id", "left").withColumn("results", F.coalesce("results", F.array().cast(results.schema["results"].dataType)))
    wrong = F.when(F.size("items") != F.size("results"), F.concat(F.size("items").cast("string"), F.lit(" items, "), F.size("results").cast("string"), F.lit(" results")))
    return both.select("job_id", wrong.alias("error"), F.posexplode_outer(F.when(wrong.isNull(), F.arrays_zip("items", "results"))).alias("place", "e")).select("job_id", "place", F.col("e.items").alias("item"), F.col("e.results").alias("result"), "error")


def naming_messages(stem: Column, ext: Column) -> Column:
    """What each naming rule that a file breaks says, in the rules' order."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    says = F.create_map(
        F.lit("basename_too_long"), F.concat(quoted(stem), F.lit(" has "), F.length(stem).cast("string"), F.lit(f" chars (max {LONGEST})")), F.lit("invalid_chars"), F.concat(quoted(stem), F.lit(" contains characters outside [A-Za-z0-9_-]")),
        F.lit("uppercase_ext"), F.concat(quoted(ext), F.lit(" is not lowercase")), F.lit("disallowed_ext"), F.concat(quoted(ext), F.lit(f" is not in {ALLOWED}")), F.lit("ad_substring"), F.concat(quoted(stem), F.lit(" contains the substring 'ad' (ad-blocker risk)")),
    )
    return F.transform(name_errors(stem, ext), lambda code: F.concat(code, F.lit(":"), says[code]))


def naming_blockers(pages: DataFrame) -> DataFrame:
    """One blocker for each project whose files would break naming rules: all that the rules say, joined by ``; ``.

    ``pages``: project_id, pos, prefix.  Each page makes a .png and a .txt; what rules say of files comes in the pages' order, then
    what they say of the package.
    """
    said = pages.select("project_id", "pos", F.concat(*(naming_messages(F.col("prefix"), F.lit(e)) for e in (".png", ".txt"))).alias("m"))
    said = said.where(F.size("m") > 0).select("project_id", F.lit(0).alias("part"), "pos", "m")
    names = pages.select("project_id", F.col("pos"), F.concat("prefix", F.lit(".png")).alias("name"))
    whole = checks.package_errors(names).where("code = 'sort_order'").select("project_id", F.lit(1).alias("part"), F.lit(0).cast(pages.schema["pos"].dataType).alias("pos"), F.array("code").alias("m"))
    joined = said.unionByName(whole).groupBy("project_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "m"))), lambda x: x["m"])).alias("m"))
    return joined.select("project_id", F.lit(None).cast("string").alias("page_id"), F.lit("build_package").alias("stage_id"), F.lit("pgdp_naming").alias("code"), F.concat(F.lit("PGDP naming violations: "), F.array_join("m", "; ")).alias("message"))


def naming_manifest(named: DataFrame, numeric: bool = False) -> DataFrame:
    """project_id and the manifest as JSON, its rows in the order of ``pos``, and the ids of skipped leaves.

    ``named``: project_id, pos, scan, page_type, leaf_role, prefix, label, run_id.  With ``numeric`` the leaves that have a
    prefix get a running number for export, as wide as their count needs, three digits at least.
    """
    order = Window.partitionBy("project_id").orderBy("pos")
    at, total = F.count("prefix").over(order), F.count("prefix").over(Window.partitionBy("project_id"))
    number = F.when(F.col("prefix").isNotNull() & F.lit(numeric), F.when(total > 999, F.format_string("%04d", at - 1)).otherwise(F.format_string("%03d", at - 1)))
    entry = F.struct(page_id(F.col("scan")).alias("page_id"), F.col("scan").alias("idx0"), F.col("page_type").alias("role"), "prefix", F.col("export_name"), "label", "run_id")
    rows = named.withColumn("export_name", number).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e"), (F.col("prefix").isNull() & (F.col("leaf_role") == "skip")).alias("skip")))).alias("all"))
    skipped = F.transform(F.filter("all", lambda x: x["skip"]), lambda x: x["e"]["page_id"])
    told = F.struct(F.lit(MANIFEST_VERSION).alias("version"), F.transform("all", lambda x: x["e"]).alias("pages"), skipped.alias("skip_ids"))
    return rows.select("project_id", F.to_json(told, {"ignoreNullFields": "false"}).alias("manifest"))


_PAGE = "struct<page_id:string,idx0:int,role:string,prefix:string,export_name:string>"


def parsed_manifests(found: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, pages, skip_ids and error for each of ``projects``; ``found``: project_id, manifest (JSON).

    A manifest that is missing, can't be read or is of another version has an error and no pages.
    """
    parsed = projects.select("project_id").join(found, "project_id", "left").withColumn("m", F.from_json("manifest", f"struct<version:int,pages:array<{_PAGE}>,skip_ids:array<string>>"))
    broken = F.try_parse_json("manifest").isNull()
    version = F.coalesce("m.version", F.lit(0))
    error = F.when(F.col("manifest").isNull(), "not found").when(broken, "unreadable").when(version != MANIFEST_VERSION, F.concat(F.lit("version "), version.cast("string"), F.lit(" is not supported")))
    none = lambda c, kind: F.when(error.isNull(), F.coalesce(c, F.array().cast(kind)))
    return parsed.select("project_id", none("m.pages", f"array<{_PAGE}>").alias("pages"), none("m.skip_ids", "array<string>").alias("skip_ids"), error.alias("error"))


_RUN = "struct<id:string,label:string,style:string,start_mode:string,start:int,step:int,role:string,span:array<int>,note:string>"


def parsed_runs(found: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, position and fields of each numbering run; ``found``: project_id, runs (JSON).

    Runs are kept in an object; a missing file, the bare list of old files and what can't be read have none.  Fields left out
    have the defaults of a new run.
    """
    parsed = projects.select("project_id").join(found, "project_id", "left")
    kept = F.from_json("runs", f"struct<version:int,runs:array<{_RUN}>>")["runs"]
    # A run without id isn't one: the whole file counts as unreadable.
    kept = F.when(~F.exists(kept, lambda r: r.isNull() | r["id"].isNull()), kept)
    rows = parsed.select("project_id", F.posexplode(kept).alias("run_pos", "r"))
    given = {"label": "", "style": "arabic", "start_mode": "set", "start": 1, "step": 1, "role": "text", "note": ""}
    return rows.select("project_id", "run_pos", F.col("r.id").alias("run_id"), *(F.coalesce(f"r.{k}", F.lit(v)).alias(k) for k, v in given.items()), F.get("r.span", F.lit(0)).alias("lo"), F.get("r.span", F.lit(1)).alias("hi"))


def confirmations(events: DataFrame) -> DataFrame:
    """The review confirmation in force of each project's stage; ``events``: project_id, stage, seq, actor_id, confirmed (false takes it back)."""
    last = events.groupBy("project_id", "stage").agg(F.max_by(F.struct("confirmed", "actor_id", "seq"), "seq").alias("e"))
    return last.where("e.confirmed").select("project_id", "stage", "e.actor_id", "e.seq")


def waived(blockers: DataFrame, waivers: DataFrame) -> DataFrame:
    """Blockers with the ``reason`` of the newest waiver of their code and page, null for those that stand.

    ``waivers``: project_id, code, page_id (null: all pages), seq, reason.
    """
    newest = waivers.groupBy("project_id", "code", "page_id").agg(F.max_by("reason", "seq").alias("reason"))
    own = newest.where("page_id is not null")
    general = newest.where("page_id is null").select("project_id", "code", F.col("reason").alias("_general"))
    return blockers.join(own, ["project_id", "code", "page_id"], "left").join(general, ["project_id", "code"], "left").select(*blockers.columns, F.coalesce("reason", "_general").alias("reason"))


def gate_event(gates: DataFrame, actor: str) -> DataFrame:
    """An event row for each project whose gate is open: confirmed by ``actor``; ``gates``: project_id, stage, missing (array), at."""
    return gates.where(F.size("missing") == 0).select("project_id", "stage", F.lit("GateConfirmed").alias("event"), F.lit(actor).alias("actor_id"), "at")


def reviewed_texts(joined: DataFrame, passed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The text that review starts from, that of the regex stage where it has run, and its attestation, which is empty."""
    both = joined.select(*key, F.col("text").alias("_joined")).join(passed.select(*key, F.col("text").alias("_passed")), list(key), "left")
    return both.select(*key, F.coalesce("_passed", "_joined").alias("text"), F.lit("{}").alias("attestation"))


def duration_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds from start to end; null while it runs, and 0 where clocks ran back."""
    return F.greatest(F.unix_millis(ended.cast("timestamp")) - F.unix_millis(started.cast("timestamp")), F.when(ended.isNotNull() & started.isNotNull(), F.lit(0).cast("long")))
