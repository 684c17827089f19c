"""Command line: run a registered query, or one of the engine's tasks, over a folder of tables or pages.

    python -m pagewright list | QUERY FOLDER | explain:QUERY FOLDER
    python -m pagewright config
    python -m pagewright text|extract|report|ask|diff|bench FOLDER ...

Tasks read a folder of HTML files (or, with --pages, a Parquet table of page_id, url, html).
"""

from __future__ import annotations

import argparse
import ast
import importlib
import json
import os
import pkgutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import pagewright
from pagewright import catalog
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import assemble, evaluate, facts, parse, report, site
from pagewright.session import session
from pagewright.sources import readers, sinks, stores

PARTS = ("functions", "operators", "sources", "streaming")


def describe_config() -> list[tuple[str, str, str]]:
    """(module, name, value) of every constant of the engine, read from the sources of its modules."""
    out = []
    for part in PARTS:
        package = importlib.import_module(f"{pagewright.__name__}.{part}")
        for found in pkgutil.iter_modules(package.__path__):
            for node in ast.parse(Path(package.__path__[0], f"{found.name}.py").read_text(encoding="utf-8")).body:
                if isinstance(node, ast.Assign):
                    names = [n.id for t in node.targets for n in (t.elts if isinstance(t, ast.Tuple) else [t]) if isinstance(n, ast.Name) and n.id.isupper()]
                    values = node.value.elts if isinstance(node.value, ast.Tuple) and len(names) > 1 else [node.value]
                    out += [(f"{part}.{found.name}", n, ast.unparse(v)[:200]) for n, v in zip(names, values, strict=False)]
    return out


def settings(environ: dict[str, str] | None = None) -> dict:
    """Spark settings from PAGEWRIGHT_* variables over the defaults: PAGEWRIGHT_SPARK_SQL_SHUFFLE_PARTITIONS and so on."""
    environ = os.environ if environ is None else environ
    return {k.removeprefix("PAGEWRIGHT_").lower(): v for k, v in sorted(environ.items()) if k.startswith("PAGEWRIGHT_SPARK_")}


def probe(pages: DataFrame) -> dict:
    """What a few pages of a site say: how many need a browser, and the strategy to read it by."""
    parsed = parse.parse_pages(pages)
    words = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(F.split(b["text"], r"\s+")))
    row = parsed.agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull() & (words < 20)).alias("shells")).first()
    read = row.pages - row.failed
    strategy = "rendered-only" if read and row.shells == read else "union" if row.shells else "static-only"
    return row.asDict() | {"strategy": strategy}


def _pages(spark, a) -> DataFrame:
    return spark.read.parquet(a.folder) if a.pages else readers.html_folder(spark, a.folder, a.root)


def _show(df: DataFrame, out: str | None) -> None:
    if out:
        df.write.mode("overwrite").json(out)
    else:
        df.show(50, truncate=120)


def run_task(a) -> int:
    spark = session(a.master, **settings())
    pages = _pages(spark, a)
    if a.name == "text":
        _show(assemble.content_of(parse.staged_pages(pages)), a.out)
    elif a.name == "extract":
        schema = json.loads(Path(a.schema).read_text(encoding="utf-8")) if a.schema else facts.schema_for(a.type)
        _show(facts.merge_facts(facts.extract_facts(parse.payloads_of(parse.parse_pages(pages)), schema)), a.out)
    elif a.name == "report":
        measured = report.measure_pages(parse.staged_pages(pages)).withColumn("site", U.site_host(F.col("url"))).withColumn("wall", F.lit(None).cast("string"))
        _show(report.site_report(measured), a.out)
    elif a.name == "ask":
        secs = site.sections(parse.blocks_of(parse.staged_pages(pages))).withColumn("id", F.concat_ws("#", "page_id", "section"))
        ranked = site.bm25(secs, "id", F.col("text"), a.question, F.col("heading")).join(secs, "id")
        ranked = ranked.select("id", F.col("page_id").cast("string").alias("page"), "heading", "text", "score", F.lit("match").alias("reason"), F.lit(0).alias("hops"))
        print(site.render_context(site.assemble_context(ranked, a.budget)).first().value)
    elif a.name == "diff":
        store = stores.GraphStore(spark, a.store)
        now = assemble.page_text(parse.blocks_of(parse.staged_pages(pages))).join(pages.select("page_id", U.page_key(F.col("url")).alias("key")), "page_id").select("key", "content_hash")
        before = store.load(a.root)
        changes = site.diff_pages(before["pages"], now) if before else now.select("key", F.lit("added").alias("change"))
        line = stores.diff_summary(changes).first().value
        changed = changes.where("change <> 'unchanged'").count()
        store.save(a.root, {"pages": now})
        print(line)
        return int(a.fail_on_change and changed > 0)
    elif a.name == "bench":
        corpus, gold = readers.gold_corpus(spark, a.folder)
        score = evaluate.corpus_score(evaluate.run_corpus(corpus, gold, facts.schema_for(a.type)), a.gate).first()
        print(json.dumps(score.asDict()))
        return int(not score.passed)
    return 0


TASKS = ("text", "extract", "report", "ask", "diff", "bench")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("name", help="a query, explain:QUERY, list, config, or one of " + ", ".join(TASKS))
    p.add_argument("folder", nargs="?")
    p.add_argument("--out", help="write here instead of showing rows")
    p.add_argument("--master")
    p.add_argument("--pages", action="store_true", help="the folder is a Parquet table of pages")
    p.add_argument("--root", default="https://site.example/", help="address of a folder of HTML files")
    p.add_argument("--schema", help="a JSON Schema file for extract")
    p.add_argument("--type", help="a page type with a built-in schema")
    p.add_argument("--question", default="", help="for ask")
    p.add_argument("--budget", type=int, default=8000, help="characters of context")
    p.add_argument("--store", help="folder of stored graphs for diff")
    p.add_argument("--fail-on-change", action="store_true")
    p.add_argument("--gate", type=float, default=0.0, help="least accuracy of bench")
    a = p.parse_args(args)
    catalog.load()
    if a.name == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.name == "config":
        print("\n".join(f"{m}.{n} = {v}" for m, n, v in describe_config()))
        return 0
    if a.name in TASKS and a.folder:
        return run_task(a)
    name = a.name.removeprefix("explain:")
    if name not in catalog.QUERIES or not a.folder:
        p.error("give a registered query or a task, and a folder")
    df = catalog.QUERIES[name](session(a.master, **settings()), a.folder)
    if a.name != name:
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
