"""Immutable raw runs: Parquet rows, a query record and a manifest that commits them.

Layout: ``<root>/extraction_date=YYYY-MM-DD/run_id=<id>/{data,query,manifest}``.
A run without a valid success manifest does not exist for readers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from dueward.config import COMPLETION_STATUSES, DATASET_ID, FORBIDDEN_MANIFEST_KEYS, Scope
from dueward.functions.numbers import holds
from dueward.functions.time import is_zoned, iso_text
from dueward.schemas import MANIFEST_SCHEMA, RAW_COLUMNS, ROW_ID, ROW_PLACE

# Manifest contract.
REQUIRED_TEXT = (
    "source_name", "dataset_id", "base_url", "scope_authority_path", "selected_agency",
    "selected_complaint_type", "where_clause", "query_hash", "run_id",
)
UTC_FIELDS = (
    "scope_authority_extraction_timestamp", "extraction_start_utc", "extraction_completion_utc",
    "count_preflight_utc", "count_postflight_utc",
)


class RunExists(RuntimeError):
    """A run directory is already taken."""


class RunUnreadable(RuntimeError):
    """A run misses an artifact or breaks its contract."""


@dataclass(frozen=True)
class RunPaths:
    root: str
    extraction_date: str
    run_id: str

    @property
    def folder(self) -> str:
        return f"{self.root}/extraction_date={self.extraction_date}/run_id={self.run_id}"

    @property
    def data(self) -> str:
        return f"{self.folder}/data"

    @property
    def query(self) -> str:
        return f"{self.folder}/query"

    @property
    def manifest(self) -> str:
        return f"{self.folder}/manifest"


def plan_hash(scope: Scope, columns: Sequence[str] = RAW_COLUMNS, page_size: int = 10_000) -> Column:
    """Sixteen hex digits that identify what was asked for."""
    text = json.dumps({
        "agency": scope.agency, "columns": list(columns), "complaint_type": scope.complaint_type,
        "end_date": scope.end.isoformat(), "order_by": ["created_date ASC", "unique_key ASC"],
        "page_size": page_size, "start_date": scope.start.isoformat(),
    }, sort_keys=True, separators=(",", ":"))
    return F.substring(F.sha2(F.lit(text), 256), 1, 16)


def run_paths(spark: SparkSession, root: str, scope: Scope, started_at: datetime) -> RunPaths:
    moment = started_at.astimezone(timezone.utc)
    digest = spark.range(1).select(plan_hash(scope).alias("h")).first()["h"]
    return RunPaths(root, f"{moment:%Y-%m-%d}", f"{moment:%Y%m%dT%H%M%SZ}_{digest}")


# ---- manifests --------------------------------------------------------------

def manifest_rules() -> dict[str, Column]:
    """What a valid manifest satisfies; an unknown outcome counts as a breach."""
    present = None
    for name in REQUIRED_TEXT:
        term = holds(F.col(name) != "")
        present = term if present is None else present & term
    in_utc = None
    for name in UTC_FIELDS:
        term = holds(F.try_to_timestamp(F.col(name)).isNotNull() & is_zoned(F.col(name))
                     & F.col(name).rlike(r"(Z|[+-]00:?00|[+-]00)$"))
        in_utc = term if in_utc is None else in_utc & term
    keys = F.transform(F.json_object_keys("json_text"), lambda k: F.lower(k))
    secrets = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in FORBIDDEN_MANIFEST_KEYS]))
    counted = F.aggregate("page_row_counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return {
        "required_text_present": present,
        "completion_status_known": holds(F.col("completion_status").isin(list(COMPLETION_STATUSES))),
        "page_count_matches": holds(F.col("page_count") == F.size("page_row_counts")),
        "page_rows_match_retrieved": holds(counted == F.col("retrieved_row_count")),
        "counts_not_negative": holds((F.col("expected_source_count") >= 0) & (F.col("retrieved_row_count") >= 0)),
        "timestamps_in_utc": in_utc,
        "no_secret_keys": holds(~secrets),
    }


def manifest_check(manifests: DataFrame) -> DataFrame:
    """One row per (run, rule)."""
    rules = manifest_rules()
    return manifests.select("run_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), c.alias("passed")) for n, c in rules.items()])))


def successful(manifests: DataFrame) -> DataFrame:
    valid = None
    for c in manifest_rules().values():
        valid = c if valid is None else valid & c
    return manifests.where(valid & (F.col("completion_status") == "success"))


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every manifest under a root with its partition values and raw text."""
    text = spark.read.option("wholetext", True).option("basePath", root).text(
        f"{root}/extraction_date=*/run_id=*/manifest")
    parsed = text.select(
        F.col("value").alias("json_text"), F.from_json("value", MANIFEST_SCHEMA).alias("m"),
        F.date_format("extraction_date", "yyyy-MM-dd").alias("extraction_date"), F.col("run_id").alias("folder_run_id"))
    return parsed.select("m.*", "json_text", "extraction_date", "folder_run_id")


def latest_run(manifests: DataFrame) -> DataFrame:
    """The successful run with the greatest folder name."""
    by = F.col("folder_run_id") if "folder_run_id" in manifests.columns else F.col("run_id")
    kept = [c for c in ("run_id", "extraction_date", "folder_run_id", "retrieved_row_count", "selected_agency",
                        "extraction_completion_utc") if c in manifests.columns]
    return successful(manifests).agg(F.max_by(F.struct(*kept), by).alias("r")).where(
        F.col("r").isNotNull()).select("r.*")


def build_manifest(raw: DataFrame, pages: DataFrame, scope: Scope, paths: RunPaths, *, expected: int,
                   started_at: datetime, completed_at: datetime, query_hash: str, source: str,
                   authority_path: str, warnings: Sequence[str] = (), page_size: int | None = None,
                   counted_before: datetime | None = None, counted_after: datetime | None = None,
                   status: str = "success") -> DataFrame:
    """The run's facts as one row: keys grouped, bounds aggregated, pages listed in order as the contract asks.

    ``counted_before`` and ``counted_after`` are the moments at which the source was counted; without them the
    manifest holds NULL and is not a valid success manifest. ``page_size`` is what the pages asked for.
    """
    from dueward.functions.time import parse_timestamp

    keys = raw.groupBy("unique_key").agg(
        F.count(F.lit(1)).alias("n"), F.min(parse_timestamp(F.col("created_date"))).alias("lo"),
        F.max(parse_timestamp(F.col("created_date"))).alias("hi"))
    facts = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("retrieved_row_count"),
        F.count("unique_key").alias("unique_key_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_unique_key_count"),
        iso_text(F.min("lo")).alias("minimum_created_date"), iso_text(F.max("hi")).alias("maximum_created_date"),
    ).withColumn("_one", F.lit(1))
    listed = pages.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("page_number", "returned_rows"))), lambda p: p["returned_rows"]
    ).alias("page_row_counts")).withColumn("_one", F.lit(1))
    end = scope.end_exclusive.isoformat()
    fixed = {
        "source_name": "service requests", "dataset_id": DATASET_ID, "base_url": source,
        "scope_authority_path": authority_path,
        "scope_authority_extraction_timestamp": scope.extracted_at.isoformat(),
        "selected_agency": scope.agency, "selected_complaint_type": scope.complaint_type,
        "selected_start_date": scope.start.isoformat(), "selected_end_date": scope.end.isoformat(),
        "extraction_start_utc": started_at.isoformat(), "extraction_completion_utc": completed_at.isoformat(),
        "count_preflight_utc": counted_before and counted_before.isoformat(),
        "count_postflight_utc": counted_after and counted_after.isoformat(),
        "where_clause": f"agency = {scope.agency} and complaint_type = {scope.complaint_type} "
                        f"and created_date in [{scope.start.isoformat()}, {end})",
        "page_size": page_size, "timeout_seconds": 0.0, "maximum_retries": 0, "expected_source_count": expected,
        "retry_count": 0, "raw_file_path": paths.data, "raw_file_format": "parquet", "schema_version": "1.0",
        "query_hash": query_hash, "run_id": paths.run_id, "completion_status": status, "python_version": "",
        "package_version": None, "raw_file_size": None,
    }
    lists = {"selected_source_columns": list(RAW_COLUMNS), "ordering": ["created_date ASC", "unique_key ASC"],
             "warnings": list(warnings)}
    joined = facts.join(F.broadcast(listed), "_one")
    columns = []
    for f in MANIFEST_SCHEMA.fields:
        if f.name in fixed:
            c = F.lit(fixed[f.name])
        elif f.name in lists:
            c = F.array(*[F.lit(v) for v in lists[f.name]])
        elif f.name == "page_count":
            c = F.size("page_row_counts")
        else:
            c = F.col(f.name)
        columns.append(c.cast(f.dataType).alias(f.name))
    return joined.select(*columns)


# ---- writing and reading ----------------------------------------------------

def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def guard_run(spark: SparkSession, paths: RunPaths, *, overwrite: bool = False) -> None:
    """A successful run is never replaced; an incomplete one only on request."""
    if not exists(spark, paths.folder):
        return
    try:
        done = read_manifests(spark, paths.root).where(F.col("folder_run_id") == paths.run_id)
        complete = not successful(done).isEmpty()
    except AnalysisException:  # no manifest anywhere under the root
        complete = False
    if complete:
        raise RunExists(f"A successful run is immutable: {paths.folder}")
    if not overwrite:
        raise RunExists(f"An incomplete run exists and overwrite was not asked for: {paths.folder}")
    discard_run(spark, paths)


def discard_run(spark: SparkSession, paths: RunPaths) -> None:
    fs, p = _folder(spark, paths.folder)
    fs.delete(p, True)


def discard_folder(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; an existing target, also one that appeared a moment ago, is an error and stays as it is."""
    jvm = spark._jvm
    _, there = _folder(spark, target)
    fs, here = _folder(spark, source)
    fs.mkdirs(there.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(here, there, options)
    except Exception as error:
        raise RunExists(f"The run's folder is taken: {target}") from error


def _agree(manifest: dict, columns: Sequence[str], stored: DataFrame, seen: int) -> None:
    """The rows read back, the rows the write saw and what the manifest states; a success manifest must agree in every count.

    The count read back comes from the files' footers.
    """
    if stored.columns != list(columns):
        raise RunUnreadable("Stored columns differ from the columns written.")
    rows = stored.count()
    stated = manifest["retrieved_row_count"]
    if not rows == seen == stated:
        raise RunUnreadable(f"{seen} rows were written, {rows} were stored, the manifest states {stated}.")
    if manifest["completion_status"] == "success" and not rows == sum(manifest["page_row_counts"]) == manifest["expected_source_count"]:
        raise RunUnreadable("A success manifest must agree with the pages and with the source's count.")


def write_run(raw: DataFrame, manifest_of, query_text: str, paths: RunPaths) -> None:
    """Store a run in a staging folder of its own, read it back, and rename it into place as the last step.

    The write itself counts the rows and takes their fingerprint, which the run keeps. ``manifest_of`` maps the stored rows to their one-row manifest. A failure removes the staging folder and nothing
    else, so two writers with equal paths leave the first run as it was.
    """
    spark = raw.sparkSession
    columns = [c for c in (*RAW_COLUMNS, ROW_ID, ROW_PLACE) if c in raw.columns]
    if exists(spark, paths.folder):
        raise RunExists(f"The run's folder is taken: {paths.folder}")
    staging = f"{paths.root}/_staging/{paths.run_id}-{uuid.uuid4().hex}"
    seen = Observation("rows")
    try:
        raw.select(*columns).observe(seen, *fingerprint_sums(columns)).write.mode("errorifexists").parquet(f"{staging}/data")
        stored = spark.read.parquet(f"{staging}/data")
        fs, data = _folder(spark, f"{staging}/data")
        manifest = manifest_of(stored).withColumn(
            "raw_file_size", F.lit(fs.getContentSummary(data).getLength()).cast(MANIFEST_SCHEMA["raw_file_size"].dataType))
        manifest.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{staging}/manifest")
        written = spark.read.schema(MANIFEST_SCHEMA).json(f"{staging}/manifest").first().asDict(recursive=True)
        _agree(written, columns, stored, seen.get["row_count"])
        for name, text in (("query", query_text), ("fingerprint", json.dumps({**seen.get, "columns": columns}))):
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{staging}/{name}")
        _move(spark, staging, paths.folder)
    finally:
        fs, p = _folder(spark, staging)
        fs.delete(p, True)


def read_run(spark: SparkSession, root: str, extraction_date: str, run_id: str) -> tuple[DataFrame, dict]:
    """Rows and manifest of one run after its contract was checked."""
    paths = RunPaths(root, extraction_date, run_id)
    for label, path in (("manifest", paths.manifest), ("query", paths.query), ("data", paths.data)):
        if not exists(spark, path):
            raise RunUnreadable(f"The run has no {label}: {path}")
    found = read_manifests(spark, root).where(
        (F.col("folder_run_id") == run_id) & (F.col("extraction_date") == extraction_date))
    valid = successful(found).limit(2).collect()
    if len(valid) != 1:
        raise RunUnreadable(f"The run has no valid success manifest: {paths.folder}")
    manifest = valid[0].asDict(recursive=True)
    if (manifest["raw_file_format"] or "").lower() != "parquet":
        raise RunUnreadable(f"Unsupported raw format: {manifest['raw_file_format']}")
    if manifest["raw_file_path"].rstrip("/") != paths.data:
        raise RunUnreadable("raw_file_path points elsewhere.")
    return spark.read.parquet(paths.data), manifest


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every part file, combined with count and size; for files that fit a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    digest = F.sha2("content", 256)
    return files.select("path", "length", digest.alias("digest")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "digest")).alias("combined"))


def fingerprint_sums(columns: Sequence[str]) -> list[Column]:
    """Row count and two order-free sums of row hashes; sums, unlike exclusive-or, do not cancel for equal rows."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns]
    wide = "decimal(38,0)"
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.xxhash64(*values).cast(wide)), F.lit(0).cast(wide)).cast("string").alias("h1"),
        F.coalesce(F.sum(F.xxhash64(F.lit(1), *values).cast(wide)), F.lit(0).cast(wide)).cast("string").alias("h2"),
    ]


def content_fingerprint(df: DataFrame) -> DataFrame:
    """The fingerprint of a table's rows, for runs of any size."""
    return df.agg(*fingerprint_sums(df.columns))


def stored_fingerprint(spark: SparkSession, paths: RunPaths) -> dict | None:
    """What the run's write observed; NULL for a run of an earlier layout."""
    path = f"{paths.folder}/fingerprint"
    return json.loads(spark.read.text(path).first()["value"]) if exists(spark, path) else None


def listing(spark: SparkSession, path: str) -> set[tuple[str, int, int]]:
    """Name, length and modification time of a run's data files: a file cannot change without one of them."""
    fs, folder = _folder(spark, path)
    return {(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(folder)}
