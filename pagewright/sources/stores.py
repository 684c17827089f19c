"""Stores of watches, graphs and knowledge: append-only Parquet tables of which readers see the newest version of each key.

A write appends files with a time and never touches older ones, so a failed write leaves no half rows behind: files without
a commit are not read, and `version` folders count only once their marker is written.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import site

CLIP, SECTIONS = 400, 40


def now_micros() -> int:
    return time.time_ns() // 1000


class Files:
    """Folders of any file system that Spark can open."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        path = self._path(f"{self.folder}/{below}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, below: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{below}"))

    def delete(self, below: str) -> bool:
        return self._fs.delete(self._path(f"{self.folder}/{below}"), True)


class Log(Files):
    """One append-only table. Rows of equal keys are versions of one; a row with `_gone` takes its key away."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...]):
        super().__init__(spark, folder)
        self.schema, self.keys = schema, keys

    def append(self, rows: DataFrame, at: int | None = None, gone: bool = False) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows = rows.select(*(F.col(n) if n in rows.columns else F.lit(None).alias(n) for n in names))
        rows = self.spark.createDataFrame([], self.schema).unionByName(rows).withColumn("_at", F.lit(at or now_micros())).withColumn("_gone", F.lit(gone))
        rows.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/table")

    def put(self, at: int | None = None, gone: bool = False, **row) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        self.append(self.spark.createDataFrame([tuple(row.get(n) for n in names)], self.schema), at, gone)

    def versions(self) -> DataFrame:
        schema = f"{self.schema}, _at bigint, _gone boolean"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/table") if self.exists("table") else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The newest version of every key that is not gone."""
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("_at"))
        return self.versions().withColumn("_n", F.row_number().over(newest)).where("_n = 1 and not _gone").drop("_n", "_gone")


class GraphStore(Files):
    """Whole graphs by root: each save is a version of several tables, visible once all of them are written."""

    def _root(self, root: str) -> str:
        return hashlib.sha1(root.encode()).hexdigest()[:16]

    def save(self, root: str, tables: dict[str, DataFrame], at: int | None = None) -> str:
        name = f"{self._root(root)}/{at or now_micros():020d}-{uuid.uuid4().hex[:8]}"
        for kind, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}/{kind}")
        self.spark.createDataFrame([(root, sorted(tables))], "root string, kinds array<string>").coalesce(1).write.json(f"{self.folder}/{name}/_done")
        return name

    def _finished(self) -> list[tuple[str, str]]:
        return [(r, v) for r in self.names() for v in self.names(r) if self.exists(f"{r}/{v}/_done/_SUCCESS")]

    def load(self, root: str) -> dict[str, DataFrame] | None:
        """Tables of the newest finished version; None if there is none."""
        mine = sorted(v for r, v in self._finished() if r == self._root(root))
        if not mine:
            return None
        at = f"{self._root(root)}/{mine[-1]}"
        return {k: self.spark.read.parquet(f"{self.folder}/{at}/{k}") for k in self.names(at) if not k.startswith("_")}

    def stored(self) -> list[tuple[str, int]]:
        """(root, time) of stored graphs, newest first: a row a version."""
        found = [(self.spark.read.json(f"{self.folder}/{r}/{v}/_done").first().root, int(v.split("-")[0])) for r, v in self._finished()]
        return sorted(found, key=lambda x: (-x[1], x[0]))

    def prune(self, keep: int | None = None, older_than: int | None = None) -> int:
        """Delete finished versions beyond the newest `keep`, and those before a time in microseconds; how many went."""
        newest = sorted(self._finished(), key=lambda x: x[1], reverse=True)
        doomed = [x for i, x in enumerate(newest) if (keep is not None and i >= keep) or (older_than is not None and int(x[1].split("-")[0]) < older_than)]
        return sum(self.delete(f"{r}/{v}") for r, v in doomed)


class WatchStore:
    """Watches, their runs, the pages each run saw, and the changes it found."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        log = lambda name, schema, *keys: Log(spark, f"{folder.rstrip('/')}/{name}", schema, keys)
        self.watches = log("watches", "watch string, url string, options string, created bigint", "watch")
        self.runs_log = log("runs", "run string, watch string, options string, started bigint, finished bigint, status string, pages bigint, changes bigint", "run")
        self.pages = log("pages", "run string, key string, url string, status int, content_hash string, title string, text string", "run", "key")
        self.changes_log = log("changes", "change_id string, watch string, run string, key string, url string, title string, change string, detail string, at bigint", "change_id")

    def create_watch(self, url: str, options: dict | None = None, at: int | None = None) -> str:
        watch = uuid.uuid4().hex[:12]
        self.watches.put(at, watch=watch, url=url, options=json.dumps(options or {}, sort_keys=True), created=at or now_micros())
        return watch

    def delete_watch(self, watch: str) -> None:
        """The watch goes with its runs, their pages and its changes."""
        runs = self.runs_log.rows().where(F.col("watch") == watch)
        self.pages.append(self.pages.rows().join(runs.select("run"), "run", "left_semi"), gone=True)
        for log in (self.changes_log, self.runs_log, self.watches):
            log.append(log.rows().where(F.col("watch") == watch), gone=True)

    def config_of(self, watch: str) -> dict:
        """Stored options over the defaults; unknown ones are left out."""
        known = {"max_pages": 300, "max_depth": 10, "include": [], "exclude": [], "noise": [], "subdomains": False}
        row = self.watches.rows().where(F.col("watch") == watch).first()
        return known | {k: v for k, v in json.loads(row.options if row else "{}").items() if k in known}

    def start_run(self, watch: str, at: int | None = None) -> str:
        run = uuid.uuid4().hex[:12]
        row = self.watches.rows().where(F.col("watch") == watch).first()
        self.runs_log.put(at, run=run, watch=watch, options=row.options if row else "{}", started=at or now_micros(), status="running")
        return run

    def finish_run(self, run: str, status: str = "finished", at: int | None = None) -> None:
        row = self.runs_log.rows().where(F.col("run") == run).first()
        pages, changes = (log.rows().where(F.col("run") == run).count() for log in (self.pages, self.changes_log))
        self.runs_log.put(at, run=run, watch=row.watch, options=row.options, started=row.started, finished=at or now_micros(), status=status, pages=pages, changes=changes)

    def runs(self, watch: str, limit: int | None = None) -> DataFrame:
        found = self.runs_log.rows().where(F.col("watch") == watch).orderBy(F.desc("started"), "run")
        return found.limit(limit) if limit else found

    def last_finished_run(self, watch: str) -> str | None:
        row = self.runs(watch).where("status = 'finished'").orderBy(F.desc("finished"), "run").first()
        return row.run if row else None

    def baseline_run(self, watch: str, run: str) -> str | None:
        """The newest finished run before `run` with its options: other options see other pages."""
        mine = self.runs_log.rows().where(F.col("run") == run).first()
        row = self.runs(watch).where((F.col("status") == "finished") & (F.col("options") == mine.options) & (F.col("started") < mine.started)).orderBy(F.desc("finished"), "run").first()
        return row.run if row else None

    def save_pages(self, run: str, pages: DataFrame, at: int | None = None) -> None:
        """Insert or replace snapshots (key, url, status, content_hash, title, text) of a run."""
        self.pages.append(pages.withColumn("run", F.lit(run)), at)

    def pages_of(self, run: str | None) -> DataFrame:
        return self.pages.rows().where(F.col("run") == F.lit(run)).drop("_at")

    def add_changes(self, watch: str, run: str, changes: DataFrame, at: int | None = None) -> None:
        """Changes (key, url, title, change, detail), each under an id of its run and key."""
        rows = changes.withColumn("watch", F.lit(watch)).withColumn("run", F.lit(run)).withColumn("at", F.lit(at or now_micros()))
        self.changes_log.append(rows.withColumn("change_id", T.short_id("chg", F.lit(run), F.col("key"), F.col("change"))), at)

    def changes(self, watch: str, since: Column | None = None, run: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
        """Changes, newest first; since is a timestamp."""
        found = self.changes_log.rows().where(F.col("watch") == watch)
        if since is not None:
            found = found.where(F.timestamp_micros("at") >= since)
        if run:
            found = found.where(F.col("run") == run)
        if kind:
            found = found.where(F.col("change") == kind)
        found = found.orderBy(F.desc("at"), "url", "change_id")
        return found.limit(limit) if limit else found

    def count_changes(self) -> DataFrame:
        return self.changes_log.rows().groupBy("watch").agg(F.count("*").alias("changes"))

    def run_watch(self, watch: str, pages: DataFrame, at: int | None = None) -> dict:
        """One run over fetched pages (key, url, status, content_hash, title, text): saved, compared with the baseline,
        changes stored. The first run of a watch is its baseline and changes nothing. Counts by kind are returned."""
        config = self.config_of(watch)
        run = self.start_run(watch, at)
        self.save_pages(run, pages, at)
        base = self.baseline_run(watch, run)
        counts = {"run": run, "pages": pages.count(), "added": 0, "removed": 0, "changed": 0, "suppressed": 0}
        if base:
            before, after = self.pages_of(base), self.pages_of(run)
            verdicts = site.watch_verdicts(before, after, tuple(config["noise"])).where("verdict is not null")
            counts |= {r.verdict: r["count"] for r in verdicts.groupBy("verdict").count().collect()}  # four kinds at most
            found = verdicts.where("verdict <> 'suppressed'").join(changed_pages(before, after), "key")
            self.add_changes(watch, run, found.select("key", "url", "title", F.col("verdict").alias("change"), "detail"), at)
        self.finish_run(run, at=at)
        return counts


def changed_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, url, title, detail): what to say of each page, with its paragraphs that are new and gone, clipped."""
    paragraphs = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\n+"), T.fold_space), lambda x: x != "")
    b = before.select("key", F.col("url").alias("_u"), F.col("title").alias("_t"), paragraphs(F.col("text")).alias("_b"))
    both = after.select("key", "url", "title", paragraphs(F.col("text")).alias("_a")).join(b, "key", "full_outer")
    none = F.array().cast("array<string>")
    new, gone = (F.transform(F.slice(F.array_except(F.coalesce(x, none), F.coalesce(y, none)), 1, SECTIONS), lambda p: clipped(p)) for x, y in (("_a", "_b"), ("_b", "_a")))
    return both.select("key", F.coalesce("url", "_u").alias("url"), F.coalesce("title", "_t").alias("title"), F.to_json(F.struct(new.alias("added"), gone.alias("removed"))).alias("detail"))


def clipped(c: Column, most: int = CLIP) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row, one line: how many pages are added, removed, changed and unchanged."""
    n = lambda k: F.count_if(F.col("change") == k).cast("string")
    return changes.agg(F.concat(n("added"), F.lit(" added, "), n("removed"), F.lit(" removed, "), n("changed"), F.lit(" changed, "), n("unchanged"), F.lit(" unchanged")).alias("value"))


class KnowledgeStore:
    """Entities, relations and evidence of graphs; model answers by key; builds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.graphs = spark, GraphStore(spark, f"{folder.rstrip('/')}/graphs")
        self.cache = Log(spark, f"{folder.rstrip('/')}/cache", "cache_key string, value string", ("cache_key",))
        self.builds = Log(spark, f"{folder.rstrip('/')}/builds", "build string, root string, detail string, built bigint", ("build",))

    def replace_graph(self, root: str, tables: dict[str, DataFrame], at: int | None = None) -> None:
        """All tables of a root at once; readers see the old ones or the new ones."""
        self.graphs.save(root, tables, at)

    def _table(self, root: str, kind: str) -> DataFrame | None:
        return (self.graphs.load(root) or {}).get(kind)

    def entities(self, root: str) -> DataFrame | None:
        """Entities by evidence, most first, then by name."""
        t = self._table(root, "entities")
        return None if t is None else t.orderBy(F.desc("evidence"), "name", "entity_id")

    def relations(self, root: str) -> DataFrame | None:
        """Relations that are not retired."""
        t = self._table(root, "relations")
        if t is None:
            return None
        return (t.where(~F.coalesce(F.col("retired"), F.lit(False))) if "retired" in t.columns else t).orderBy(F.desc("evidence"), "relation_id")

    def evidence(self, root: str) -> DataFrame | None:
        t = self._table(root, "evidence")
        return None if t is None else t.orderBy("page_id", "pos", "start", "end")

    def cache_put(self, answers: DataFrame, at: int | None = None) -> None:
        """Answers (cache_key, value), each in place of an older one."""
        self.cache.append(answers, at)

    def cache_get(self, keys: DataFrame) -> DataFrame:
        """(cache_key, value) of the wanted keys that are known."""
        return self.cache.rows().drop("_at").join(keys.select("cache_key").distinct(), "cache_key", "left_semi")

    def record_run(self, root: str, detail: dict, at: int | None = None) -> str:
        build = uuid.uuid4().hex[:12]
        self.builds.put(at, build=build, root=root, detail=json.dumps(detail, sort_keys=True), built=at or now_micros())
        return build

    def last_run(self, root: str) -> dict | None:
        row = self.builds.rows().where(F.col("root") == root).orderBy(F.desc("built"), "build").first()
        return {"build": row.build, "at": row.built} | json.loads(row.detail) if row else None


def lean(event: dict, most: int = CLIP) -> dict:
    """An event without its large values: long texts and lists are clipped, and say how long they were."""

    def clip(v):
        if isinstance(v, str) and len(v) > most:
            return f"{v[: most - 1]}… ({len(v)} characters)"
        if isinstance(v, list | tuple):
            return [clip(x) for x in v[:20]] + ([f"… {len(v) - 20} more"] if len(v) > 20 else [])
        return {k: clip(x) for k, x in v.items()} if isinstance(v, dict) else v

    return {k: clip(v) for k, v in event.items()}


def trace_events(events: Iterator[dict], path: str, clock=time.time) -> Iterator[dict]:
    """Pass events on and write a line of each, with its time and without large values, to a log file."""
    began = clock()
    with open(path, "a", encoding="utf-8") as f:
        for event in events:
            f.write(json.dumps({"at": round(clock() - began, 3)} | lean(event), ensure_ascii=False, default=str) + "\n")
            yield event
