"""Control state: source registry, change detection, runs and tasks, migrations, snapshot packs."""

from __future__ import annotations

import hashlib
import json
import re
import time
import traceback
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- registry ---------------------------------------------------------------------------


def list_sources(registry: DataFrame, provider: str | None = None) -> DataFrame:
    return registry.where(F.col("provider") == provider) if provider else registry


def find_source(registry: DataFrame, source_id: str) -> DataFrame:
    return registry.where(F.col("id") == source_id)


def replace_source(registry: DataFrame, source_id: str, **updates) -> DataFrame:
    """The registry with new values in the row of one id; an unknown id changes nothing."""
    types = dict(registry.dtypes)
    return registry.withColumns({c: F.when(F.col("id") == source_id, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in updates.items() if c in types})


def backfill_sources(registry: DataFrame, providers: Iterable[str], generation: int = 3, ids: Iterable[str] = ()) -> DataFrame:
    """Enabled sources of the generation or a later one, of some providers, and of some ids if any are named."""
    some = registry.where(F.col("enabled") & (F.col("generation") >= generation) & F.col("provider").isin(list(providers)))
    return some.where(F.col("id").isin(list(ids))) if ids else some


def fetch_source(source: dict, readers: dict[str, Callable[[dict], DataFrame]], defaults: dict[str, dict] | None = None) -> DataFrame:
    """The rows of one source by the reader of its provider; the source's options come before the provider's."""
    provider = source.get("provider", "")
    if provider not in readers:
        raise ValueError(f"no reader for the provider {provider!r}")
    return readers[provider]({**(defaults or {}).get(provider, {}), **{k: v for k, v in source.items() if v is not None}})


# --- change detection -------------------------------------------------------------------


def source_token(files: DataFrame) -> DataFrame:
    """One row: token and number of ``files(path, modified, size)``; the token changes with any of these.

    The digests of the files are combined by sums, so no list of them is gathered.
    """
    one = F.xxhash64("path", F.col("modified").cast("string"), F.col("size").cast("long"))
    two = F.xxhash64(F.lit(1), "path", F.col("modified").cast("string"), F.col("size").cast("long"))
    part = lambda h: F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).cast("string")
    return files.agg(F.count("*").alias("files"), F.sha1(F.concat_ws(":", F.count("*").cast("string"), part(one), part(two)).cast("binary")).alias("token"))


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, change)``: added, removed or changed files by their SHA-1 (``path, sha``)."""
    both = before.select("path", F.col("sha").alias("old")).join(now.select("path", F.col("sha").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())


def lost_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that were valid, are still there and are no longer valid (``path, valid``)."""
    return before.where("valid").select("path").join(now.where("not valid").select("path"), "path")


def sync_required(state: dict, token: str, library: str, exists: bool) -> bool:
    """Without a library, or where it or the sources are other ones than at the last sync."""
    last = state.get("library_sync", {}) if isinstance(state, dict) else {}
    return not exists or last.get("library") != library or last.get("token") != token


def enrich_required(state: dict, token: str, library: str, exists: bool, version: int) -> bool:
    """Never without a library; else as a sync, or when the last run had an older version."""
    last = state.get("enrich", {}) if isinstance(state, dict) else {}
    return exists and (last.get("library") != library or last.get("token") != token or int(last.get("version") or 0) < version)


def content_status(papers: DataFrame, manifest: DataFrame, stores: DataFrame) -> DataFrame:
    """One row: papers, valid and invalid sources, vector stores."""
    a = papers.agg(F.count("*").alias("papers"))
    b = manifest.agg(F.count_if("valid").alias("valid_sources"), F.count_if(~F.col("valid")).alias("invalid_sources"))
    c = stores.select("model", "scope").distinct().agg(F.count("*").alias("stores"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


# --- migrations -------------------------------------------------------------------------


def migrate(state: dict, steps: dict[int, Callable[[dict], dict]]) -> dict:
    """``state`` after all steps above its version, in order; each step's version is recorded."""
    now = dict(state)
    for version in sorted(steps):
        if version > int(now.get("version", 0)):
            now = {**steps[version](now), "version": version}
    return now


# --- runs -------------------------------------------------------------------------------


def resume(runs: DataFrame, signature: str) -> DataFrame:
    """The newest unfinished run with the signature of its sources, as one row or none: queued, running, interrupted or partial."""
    some = runs.where((F.col("signature") == signature) & F.col("status").isin("queued", "running", "interrupted", "partial"))
    return some.orderBy(F.desc("started"), F.desc("run_id")).limit(1)


def resumed_items(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items of a resumed run: fetched ones stay fetched only if their output exists, all others are pending."""
    kept = outputs.select("item_id", F.lit(True).alias("_kept")).distinct()
    status = F.when((F.col("status") == "fetched") & F.col("_kept"), "fetched").otherwise("pending")
    return items.join(kept, "item_id", "left").withColumn("status", status).drop("_kept")


def run_status(items: DataFrame) -> DataFrame:
    """Status of each run by its items: completed, partial (some fetched), queued (none)."""
    done, every = F.count_if(F.col("status") == "fetched"), F.count("*")
    return items.groupBy("run_id").agg(F.when(done == every, "completed").when(done > 0, "partial").otherwise("queued").alias("status"), done.alias("fetched"), every.alias("items"))


# --- tasks ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Task:
    task_id: str
    kind: str
    status: str = "queued"
    error: str = ""
    started: float = 0.0
    ended: float = 0.0


SECRET = re.compile(r"(?i)((?:api[_-]?key|token|secret|password|authorization)[\"']?\s*[:=]\s*[\"']?(?:bearer\s+)?)[^\s\"',}]+")


def masked(text: str) -> str:
    """``text`` without the values of secrets."""
    return SECRET.sub(r"\1***", text)


@dataclass
class Tasks:
    """Jobs in the background, each under its own Spark tag: queued, running, completed, failed or canceled.

    What a canceled task still returns is discarded. The last ``keep`` ended tasks are remembered.
    """

    spark: SparkSession
    workers: int = 4
    keep: int = 200
    history: list[Task] = field(default_factory=list)
    _now: dict[str, Task] = field(default_factory=dict)
    _results: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._pool = ThreadPoolExecutor(self.workers)

    def submit(self, kind: str, work: Callable[[], object]) -> tuple[str, Future]:
        task = Task(uuid.uuid4().hex, kind)
        self._now[task.task_id] = task
        return task.task_id, self._pool.submit(self._run, task.task_id, work)

    def _run(self, task_id: str, work: Callable[[], object]) -> None:
        if self.status(task_id) == "canceled":
            return
        self._now[task_id] = replace(self._now[task_id], status="running", started=time.time())
        self.spark.addTag(f"task-{task_id}")
        try:
            result, status, error = work(), "completed", ""
        except Exception:  # noqa: BLE001 - the status tells
            result, status, error = None, "failed", masked(traceback.format_exc(limit=1))
        finally:
            self.spark.removeTag(f"task-{task_id}")
        if self.status(task_id) != "canceled":
            self._results[task_id] = result
            self._end(task_id, status, error)

    def _end(self, task_id: str, status: str, error: str = "") -> None:
        self._now[task_id] = ended = replace(self._now[task_id], status=status, error=error, ended=time.time())
        self.history = [*self.history, ended][-self.keep :]

    def cancel(self, task_id: str) -> bool:
        if self.status(task_id) not in ("queued", "running"):
            return False
        self._end(task_id, "canceled")
        self.spark.interruptTag(f"task-{task_id}")
        return True

    def status(self, task_id: str) -> str:
        return self._now[task_id].status if task_id in self._now else "unknown"

    def result(self, task_id: str) -> object:
        return self._results.get(task_id)


# --- snapshot packs ---------------------------------------------------------------------


def safe_member(name: Column) -> Column:
    """Whether the name of an archive's member stays inside the folder it is unpacked to."""
    clean = F.replace(name, F.lit("\\"), F.lit("/"))
    return (clean != "") & ~clean.startswith("/") & ~clean.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(clean, "/"), "..")


def table_digest(df: DataFrame) -> tuple[int, str]:
    """Rows of a table, and a digest of their values and the columns' names, whatever the order of either."""
    columns = sorted(df.columns)
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64(*(F.col(c) for c in columns)), F.lit(1 << 31))), F.lit(0)).alias("h")).first()
    return found["n"], hashlib.sha1(f"{found['n']}:{found['h']}:{columns}".encode()).hexdigest()


def write_pack(folder: str, tables: dict[str, DataFrame], kind: str = "full") -> dict:
    """Tables as Parquet under ``folder`` and a manifest, which comes last: without it a pack isn't complete."""
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        back = spark.read.parquet(f"{folder}/{name}")
        rows, digest = table_digest(back)
        entries.append({"name": name, "rows": rows, "digest": digest})
    manifest = {"kind": kind, "tables": entries}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_pack")
    return manifest


def read_pack(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """Manifest and tables of a pack; their rows and digests must be those of the manifest."""
    manifest = json.loads(spark.read.text(f"{folder}/_pack").first()["value"])
    tables = {e["name"]: spark.read.parquet(f"{folder}/{e['name']}") for e in manifest["tables"]}
    for e in manifest["tables"]:
        rows, digest = table_digest(tables[e["name"]])
        if rows != e["rows"]:
            raise ValueError(f"{e['name']} has {rows} rows, the manifest {e['rows']}")
        if digest != e["digest"]:
            raise ValueError(f"{e['name']} has other rows than the manifest says")
    return manifest, tables
