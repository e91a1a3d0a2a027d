"""Backfills, gap detection, schema records, registries, caches with expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import simhash

#: Fields whose change makes stored vectors or chunks incompatible.
FINGERPRINT = ("embedding_model", "embedding_dim", "chunk_size", "chunk_overlap", "chunking_strategy", "schema_version")


def backfill_defaults(chunks: DataFrame) -> DataFrame:
    """version null: 1; is_current null: true; node_type null or empty: chunk."""
    kind = F.when(F.coalesce("node_type", F.lit("")) == "", F.lit("chunk")).otherwise(F.col("node_type"))
    return chunks.withColumns({"version": F.coalesce("version", F.lit(1)), "is_current": F.coalesce("is_current", F.lit(True)), "node_type": kind})


def backfill_simhash(chunks: DataFrame) -> DataFrame:
    fill = F.coalesce("is_current", F.lit(True)) & F.col("simhash").isNull()
    return chunks.withColumn("simhash", F.when(fill, simhash(F.col("text"))).otherwise(F.col("simhash")))


def first_root(paths: DataFrame, roots: DataFrame, path_col: str = "source_path") -> DataFrame:
    """The first root (by position) that each path starts with; roots are a configured list, joined as the small side."""
    j = paths.join(roots, F.col(path_col).startswith(F.col("root")), "left")
    n = F.row_number().over(Window.partitionBy(path_col).orderBy(F.asc_nulls_last("position")))
    return j.withColumn("__n", n).where("__n = 1").drop("__n")


def backfill_tags(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """root_tags and content_type of rows that have none come from the first root of their path."""
    found = first_root(chunks.select("source_path").distinct(), roots).select("source_path", F.col("tags").alias("__tags"), F.col("content_type").alias("__type"))
    j = chunks.join(found, "source_path", "left")
    return j.withColumns({"root_tags": F.coalesce("root_tags", "__tags"), "content_type": F.coalesce("content_type", "__type")}).select(*chunks.columns)


def backfill_positions(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """start_char and end_char of rows without them: where the first 100 characters stand in the text; -1 if nowhere."""
    j = chunks.join(texts.select("source_path", F.col("text").alias("__raw")), "source_path", "left")
    at = F.expr("instr(__raw, substring(text, 1, 100)) - 1")
    need = F.col("start_char").isNull() & F.col("__raw").isNotNull()
    start = F.when(need, at).otherwise(F.col("start_char"))
    end = F.when(need, F.when(at < 0, F.lit(-1)).otherwise(at + F.length("text"))).otherwise(F.col("end_char"))
    return j.withColumns({"start_char": start.cast("int"), "end_char": end.cast("int")}).select(*chunks.columns)


def files_without(chunks: DataFrame, node_type: str) -> DataFrame:
    """Source paths of current chunks that have no row of the given type."""
    c = chunks.where(F.coalesce("is_current", F.lit(True)))
    have = c.where(F.col("node_type") == node_type).select("source_path").distinct()
    return c.where(F.coalesce("node_type", F.lit("chunk")) == "chunk").select("source_path").distinct().join(have, "source_path", "left_anti")


def fingerprint_changes(history: DataFrame, config: dict[str, object]) -> DataFrame:
    """(field, recorded, configured) of fields that differ from the last record; none without records."""
    last = history.agg(F.max_by(F.struct(*FINGERPRINT), "id").alias("r")).where("r IS NOT NULL")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").cast("string").alias("recorded"), F.lit(None if config.get(f) is None else str(config[f])).alias("configured")) for f in FINGERPRINT])
    return last.select(F.explode(pairs).alias("p")).select("p.*").where(~F.col("recorded").eqNullSafe(F.col("configured")))


def completion_mode(changes: list[str], new_exts: bool, metadata_missing: bool) -> str | None:
    """What an incremental run has to redo, first reason first."""
    if {"embedding_model", "embedding_dim"} & set(changes):
        return "embedding_upgrade"
    if {"chunk_size", "chunk_overlap", "chunking_strategy"} & set(changes):
        return "chunk_boundary_update"
    if new_exts:
        return "extension_completion"
    return "metadata_enrichment" if metadata_missing else None


def new_extensions(configured: DataFrame, manifest: DataFrame) -> DataFrame:
    known = manifest.select(F.lower(F.regexp_extract("source_path", r"(\.[^./]+)$", 1)).alias("ext")).distinct()
    return configured.join(known, "ext", "left_anti")


def set_active(models: DataFrame, model_id: str) -> DataFrame:
    return models.withColumn("is_active", F.col("model_id") == model_id)


def register_model(models: DataFrame, new: DataFrame) -> DataFrame:
    """An existing row is replaced but keeps whether it is active."""
    old = models.select("model_id", F.col("is_active").alias("__active"))
    fresh = new.join(old, "model_id", "left").withColumn("is_active", F.coalesce("__active", F.lit(False))).drop("__active")
    return models.join(new, "model_id", "left_anti").unionByName(fresh.select(*models.columns))


def cluster_advice(size_now: Column, size_then: Column, growth: float = 1.2) -> Column:
    return F.coalesce(size_now > growth * size_then, F.lit(True))


def live(cache: DataFrame, as_of: Column) -> DataFrame:
    """Entries that have not expired (no expiry: they live on)."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def unseen(items: DataFrame, seen: DataFrame, key: str = "item_id") -> DataFrame:
    return items.join(seen.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def metadata_missing(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """(source_path): files with a current chunk whose content type or root tags are missing or not those of its root."""
    found = first_root(chunks.select("source_path").distinct(), roots).select("source_path", F.col("tags").alias("__tags"), F.col("content_type").alias("__type"))
    j = chunks.where(F.coalesce("is_current", F.lit(True))).join(found, "source_path").where("__tags IS NOT NULL OR __type IS NOT NULL")
    differs = ~F.col("root_tags").eqNullSafe(F.col("__tags")) | ~F.col("content_type").eqNullSafe(F.col("__type"))
    return j.where(differs).select("source_path").distinct()


def record_version(history: DataFrame, config: dict[str, object], at: Column) -> DataFrame:
    """``history`` and one more row: the fingerprint of ``config`` under the next id."""
    last = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    values = {f: F.lit(None if config.get(f) is None else str(config[f])) for f in FINGERPRINT}
    row = last.select((F.col("last") + 1).alias("id"), *[values[f].alias(f) for f in FINGERPRINT], at.alias("created_at"))
    return history.unionByName(row.select(*[F.col(c).cast(t).alias(c) for c, t in history.select(*row.columns).dtypes]), allowMissingColumns=True)


def record_job(jobs: DataFrame, name: str, at: Column, status: str = "completed", corpus_size: int | None = None) -> DataFrame:
    """``jobs`` with the job's row replaced or added."""
    values = {"job_name": F.lit(name), "status": F.lit(status), "corpus_size": F.lit(corpus_size), "finished_at": at}
    row = jobs.sparkSession.range(1).select(*[values[c].cast(t).alias(c) for c, t in jobs.dtypes if c in values])
    return jobs.where(F.col("job_name") != name).unionByName(row, allowMissingColumns=True)


def save_cached(cache: DataFrame, new: DataFrame, at: Column, ttl_seconds: int | None = None, key: str = "cache_key") -> DataFrame:
    """``cache`` after the new entries were written: stamped, expiring after ``ttl_seconds`` (None: never)."""
    expires = F.lit(None).cast("timestamp") if ttl_seconds is None else at + F.make_dt_interval(secs=F.lit(ttl_seconds))
    fresh = new.withColumn("saved_at", at).withColumn("expires_at", expires)
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*cache.columns))


def delete_model(models: DataFrame, model_id: object) -> DataFrame:
    return models.where(F.col("model_id") != model_id)


def list_models(models: DataFrame) -> DataFrame:
    """Newest first, with the position in the list."""
    return models.withColumn("position", F.row_number().over(Window.orderBy(F.desc("created_at"), "model_id")))  # a registry of a few models


#: Stage aliases of the enrichment, in the order they run.
STAGES = {"tier1": ("simhash", "defaults", "node_type", "tags", "positions"), "tier2": ("summaries",), "clusters": ("clusters",), "graph": ("graph",)}


def stage_names(asked: list[str]) -> list[str]:
    """Stages of names and aliases, each once, in running order; unknown names are errors."""
    known = [x for xs in STAGES.values() for x in xs]
    wanted = {x for a in asked for x in (known if a == "all" else STAGES.get(a, (a,)))}
    if unknown := wanted - set(known):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return [x for x in known if x in wanted]


def enrich(chunks: DataFrame, roots: DataFrame | None = None, texts: DataFrame | None = None, only: list[str] | None = None, skip: list[str] | None = None, models: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, list[str]]:
    """(chunks after the backfills that were asked for and can run, their names); one lazy plan over one scan.

    ``models`` gives steps that need a model or other tables (summaries, clusters, graph), from chunks to chunks. A stage that is
    asked for by its own name and cannot run is an error; one that only an alias or "all" brought in is passed over.
    """
    todo = [x for x in stage_names(only or ["all"]) if x not in stage_names(skip or [])]
    steps = {
        "simhash": lambda df: backfill_simhash(df) if "simhash" in df.columns else None,
        "defaults": backfill_defaults,
        "node_type": lambda df: df if "defaults" in todo else backfill_defaults(df),  # the defaults set node types
        "tags": lambda df: backfill_tags(df, roots) if roots is not None and "root_tags" in df.columns else None,
        "positions": lambda df: backfill_positions(df, texts) if texts is not None and "start_char" in df.columns else None,
    } | (models or {})
    done = []
    for name in todo:
        out = steps[name](chunks) if name in steps else None
        if out is not None:
            chunks, done = out, [*done, name]
        elif name in (only or []):
            raise ValueError(f"stage {name} cannot run: what it needs was not given")
    return chunks, done


def gap_report(chunks: DataFrame) -> DataFrame:
    """(gap, files): what is still missing after enrichment."""
    kinds = [files_without(chunks, kind).select(F.lit(f"no {kind}").alias("gap"), "source_path") for kind in ("file_summary", "section_summary")]
    c = chunks.where(F.coalesce("is_current", F.lit(True)))
    missing = [c.where(F.col(x).isNull()).select(F.lit(f"no {x}").alias("gap"), "source_path") for x in ("simhash", "cluster_id") if x in c.columns]
    every = kinds[0].unionByName(kinds[1])
    for m in missing:
        every = every.unionByName(m)
    return every.groupBy("gap").agg(F.countDistinct("source_path").alias("files"))


def health(tables: dict[str, DataFrame | None], checks: list[tuple[str, str, Column]]) -> list[tuple[str, bool]]:
    """(check, ok) in order up to the first failure: the table is there, and no row of it fulfils the condition."""
    out = []
    for name, table, broken in checks:
        found = tables.get(table)
        ok = found is not None and found.where(broken).isEmpty()
        out.append((name, ok))
        if not ok:
            break
    return out
