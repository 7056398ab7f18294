"""Recipes: a JSON list of steps that runs over many files."""

from __future__ import annotations

import json
import os.path
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.dedup import Dedup, deduplicate
from tabwright.operators.diagnose import ColumnRule, FileProfile, cell_issues_by, column_issues, validate_profile
from tabwright.operators.filters import filter_rows, from_json
from tabwright.operators.project import keep_columns
from tabwright.operators.sort import SortKey, sort_rows
from tabwright.operators.transform import Transform, transform
from tabwright.sources.delimited import FILE, ROW, Dialect, header_names, in_encodings, read_delimited, shapes
from tabwright.sources.export import Export, write_delimited, write_folders

STEPS = ("reparse", "validateProfile", "filter", "transform", "deduplicate", "selectColumns", "sort", "export")
#: Inputs that are worked on at a time.
WORKERS = 8
#: Inputs that one plan takes.
TOGETHER = 1_000
INPUT = "_input"
REPORT = "input string, output string, status string, rows_in long, rows_out long, issues long, steps array<string>, message string"


@dataclass(frozen=True)
class Recipe:
    name: str
    steps: tuple[dict, ...]
    version: int = 1


def load_recipe(text: str) -> Recipe:
    spec = json.loads(text)
    return Recipe(spec["name"], tuple(spec["steps"]), spec.get("version", 1))


def profile_from(spec: dict) -> FileProfile:
    return FileProfile(tuple(ColumnRule(**r) for r in spec.get("rules", ())), spec.get("allow_extra", True), spec.get("check_order", False), tuple(spec.get("columns", ())))


def output_name(template: str, path: str) -> str:
    """``{name}`` and ``{ext}`` are the input's; the result is one folder name."""
    name, ext = os.path.splitext(path.rstrip("/").rpartition("/")[2])
    out = template.replace("{name}", name).replace("{ext}", ext.lstrip("."))
    if "/" in out or "\\" in out or not out.strip(". "):
        raise ValueError(f"{out!r} is no file name")
    return out


def validate_recipe(recipe: Recipe, paths: list[str], profiles: dict[str, FileProfile]) -> None:
    if recipe.version != 1:
        raise ValueError(f"recipe version {recipe.version} is unknown")
    if not recipe.steps:
        raise ValueError("the recipe has no steps")
    unknown = [s.get("kind") for s in recipe.steps if s.get("kind") not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    exports = [s for s in recipe.steps if s["kind"] == "export"]
    if not exports:
        raise ValueError("the recipe exports nothing")
    for s in recipe.steps:
        if s["kind"] == "validateProfile" and s["profile"] not in profiles:
            raise ValueError(f"no profile {s['profile']!r}")
        if s["kind"] == "reparse" and s is not recipe.steps[0]:
            raise ValueError("reparse must be the first step")
    outputs = [output_name(s.get("name", "{name}"), p) for s in exports for p in paths]
    if len(set(outputs)) < len(outputs):
        raise ValueError("several outputs would have one name")


def apply_step(df: DataFrame, step: dict) -> DataFrame:
    """One step that changes rows or columns; ROW is the row order."""
    kind = step["kind"]
    inner = [c for c in df.columns if c in (ROW, FILE, INPUT)]
    own = [c for c in df.columns if c not in inner]
    several = (INPUT,) if INPUT in inner else ()
    if kind == "filter":
        return filter_rows(df, from_json(step["filter"]))
    if kind == "transform":
        return transform(df, Transform(step["transform"], step.get("options", {})), step.get("columns") or own, on_error=step.get("on_error", "skipInvalid"))
    if kind == "deduplicate":
        options = {k: v for k, v in step.items() if k in ("trim", "collapse_whitespace", "case_insensitive", "blank_keys_equal", "exclude_blank_keys")}
        return deduplicate(df, Dedup(tuple(step.get("columns") or own), within=several, **options), [ROW], step.get("keep", "first"))
    if kind == "selectColumns":
        return keep_columns(df, [*step["columns"], *inner])
    if kind == "sort":
        return sort_rows(df, [*map(SortKey, several), *(SortKey(k["column"], k.get("descending", False)) for k in step["keys"])], [ROW])
    raise ValueError(f"step {kind!r} changes no rows")


def run_recipe(spark: SparkSession, recipe: Recipe, paths: list[str], out_dir: str, profiles: dict[str, FileProfile] | None = None, dialect: Dialect = Dialect(), dry_run: bool = False, continue_on_error: bool = True, overwrite: bool = False, workers: int = WORKERS) -> DataFrame:
    """Runs a recipe on each input (a file or a folder of them, which Spark reads in parallel); the report has a row for every input, in their order.

    Inputs with the same columns are worked on together: one plan reads up to TOGETHER of them, keeps their rows apart by
    the input's number, writes a folder for each, and counts what goes in and out on the way. The others, those of a
    dialect with skipped or stacked header records, and those of a plan that failed, are jobs of their own, ``workers``
    of which are on the cluster at a time. An output that is there already makes its input ``skipped`` unless
    ``overwrite``. After an error the inputs left are ``skipped`` too, unless ``continue_on_error``; to know which are
    left, inputs then go one by one.
    """
    profiles = profiles or {}
    validate_recipe(recipe, paths, profiles)
    own = Dialect(**recipe.steps[0]["dialect"]) if recipe.steps[0]["kind"] == "reparse" else dialect
    job = _Job(spark, recipe, out_dir.rstrip("/"), profiles, own, dry_run, overwrite)
    if continue_on_error:
        report = job.together(paths) if len(paths) > 1 else {}
        left = [p for p in paths if p not in report]
        with ThreadPoolExecutor(max(1, min(workers, len(left)))) as pool:
            report |= dict(zip(left, pool.map(job.one, left)))
        rows = [report[p] for p in paths]
    else:
        rows = []
        for path in paths:
            failed = any(r[2] == "failed" for r in rows)
            rows.append((path, "", "skipped", 0, 0, 0, [], "an earlier input failed") if failed else job.one(path))
    return spark.createDataFrame(rows, REPORT)


@dataclass(frozen=True)
class _Job:
    spark: SparkSession
    recipe: Recipe
    out: str
    profiles: dict[str, FileProfile]
    dialect: Dialect
    dry_run: bool
    overwrite: bool

    def output(self, step: dict, path: str) -> str:
        return f"{self.out}/{output_name(step.get('name', '{name}'), path)}"

    @property
    def plain(self) -> bool:
        """Whether a file's records are its header and its rows."""
        return self.dialect.header_rows <= 1 and not self.dialect.skip_first and not self.dialect.skip_last

    def options(self, step: dict) -> Export:
        return Export(**{**step.get("options", {}), "if_exists": "overwrite" if self.overwrite else "error"})

    def one(self, path: str) -> tuple:
        """The report's row of one input: one pass for its width, one that writes and counts."""
        done: list[str] = []
        rows_in = rows_out = issues = 0
        output, status, message = "", "ok", ""
        try:
            files = in_encodings(self.spark, path, self.dialect)
            if self.plain:
                seen = shapes(self.spark, files, self.dialect).agg(F.max("fields").alias("fields"), F.sum(F.col("records") - self.dialect.header_rows).alias("rows")).first()
                df, rows_in = read_delimited(self.spark, files, self.dialect, width=seen["fields"] or 1, keep_row=True), seen["rows"] or 0
            else:
                df = read_delimited(self.spark, files, self.dialect, keep_row=True)
                rows_in = df.count()
            df = df.drop(FILE)
            for step in self.recipe.steps:
                if step["kind"] == "validateProfile":
                    issues += validate_profile(df.drop(ROW), self.profiles[step["profile"]]).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
                    if issues and step.get("fail_on_issues"):
                        raise ValueError(f"{issues} issues against profile {step['profile']}")
                elif step["kind"] == "export":
                    output = self.output(step, path)
                    there = not self.dry_run and not self.overwrite and _exists(self.spark, output)
                    told = Observation()
                    counted = df.drop(ROW).observe(told, F.count(F.lit(1)).alias("n"))
                    if there or self.dry_run:
                        counted.write.format("noop").mode("overwrite").save()
                    else:
                        write_delimited(counted, output, self.options(step))
                    rows_out = told.get["n"]
                    if there:
                        status, message = "skipped", "the output is there already"
                elif step["kind"] != "reparse":
                    df = apply_step(df, step)
                done.append(step["kind"])
        except Exception as e:  # an input's own trouble is part of the report
            status, message = "failed", f"{type(e).__name__}: {e}"[:500]
        return path, output, status, rows_in, rows_out, issues, done, message

    def together(self, paths: list[str]) -> dict[str, tuple]:
        """The report's rows, by input, of those that could be worked on together."""
        report: dict[str, tuple] = {}
        if not self.plain:
            return report
        try:
            alike = self.alike(paths)
        except Exception:  # noqa: BLE001  an input that can't be read at all: each tells for itself
            return report
        for names, inputs in alike.items():
            for at in range(0, len(inputs), TOGETHER):
                some = inputs[at : at + TOGETHER]
                if len(some) > 1:
                    try:
                        report |= self.many(list(names), some)
                    except Exception:  # noqa: BLE001  whose trouble it is shows when they run alone
                        continue
        return report

    def alike(self, paths: list[str]) -> dict[tuple, list[tuple[str, list[str], int]]]:
        """Inputs (path, files, rows) by their columns, from one pass over all of them; every input owns the files under it."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        plain = lambda uri: F.regexp_replace(uri, "^([a-z0-9]+):/+", "$1:/")
        places = [hadoop.Path(p) for p in paths]
        rows = [(i, p.getFileSystem(conf).makeQualified(p).toUri().toString()) for i, p in enumerate(places)]
        inputs = self.spark.createDataFrame(rows, "input int, place string").withColumn("place", plain("place"))
        found = shapes(self.spark, paths, self.dialect).withColumn("_own", plain(FILE))
        # a file and all folders above it
        parts = F.split("_own", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        owned = found.select(FILE, "records", "fields", "first", F.explode(above).alias("place")).join(inputs, "place")
        by: dict[int, list] = {}
        for r in owned.collect():
            by.setdefault(r["input"], []).append(r)
        out: dict[tuple, list[tuple[str, list[str], int]]] = {}
        for i, files in sorted(by.items()):
            files.sort(key=lambda r: r[FILE])
            width = max(r["fields"] for r in files)
            first = files[0]["first"]
            names = header_names([first + [""] * (width - len(first))]) if self.dialect.header_rows else [f"Column {k + 1}" for k in range(width)]
            out.setdefault(tuple(names), []).append((paths[i], [r[FILE] for r in files], sum(r["records"] - self.dialect.header_rows for r in files)))
        return out

    def many(self, names: list[str], inputs: list[tuple[str, list[str], int]]) -> dict[str, tuple]:
        """Runs the steps on all the inputs at once."""
        spark, paths = self.spark, [p for p, _, _ in inputs]
        numbers = spark.createDataFrame([(f, i) for i, (_, files, _) in enumerate(inputs) for f in files], f"{FILE} string, {INPUT} int")
        df = read_delimited(spark, paths, self.dialect, width=len(names), keep_row=True).join(numbers, FILE).drop(FILE)
        issues, failed, done = [0] * len(inputs), {}, []
        status, message, output, rows_out = ["ok"] * len(inputs), [""] * len(inputs), [""] * len(inputs), [0] * len(inputs)
        sorted_by_input = False
        steps_of = [[] for _ in inputs]
        for step in self.recipe.steps:
            if step["kind"] == "validateProfile":
                profile = self.profiles[step["profile"]]
                own = len(column_issues([c for c in df.columns if c not in (ROW, INPUT)], profile))
                counts = dict(cell_issues_by(df, profile, INPUT).collect())
                for i in range(len(inputs)):
                    issues[i] += own + counts.get(i, 0)
                    if issues[i] and step.get("fail_on_issues") and i not in failed:
                        failed[i] = f"ValueError: {issues[i]} issues against profile {step['profile']}"
                        steps_of[i] = list(done)
                if failed:
                    df = df.filter(~F.col(INPUT).isin(list(failed)))
            elif step["kind"] == "export":
                going = [i for i in range(len(inputs)) if i not in failed]
                for i in going:
                    output[i] = self.output(step, paths[i])
                there = {i for i in going if not self.dry_run and not self.overwrite and _exists(spark, output[i])}
                told = Observation()
                ready = df if sorted_by_input else df.sortWithinPartitions(INPUT, ROW)
                # exact, as there are as many bins as inputs
                counted = ready.drop(ROW).observe(told, F.histogram_numeric(INPUT, F.lit(max(2, len(inputs)))).alias("n"))
                if self.dry_run or len(there) == len(going):
                    counted.write.format("noop").mode("overwrite").save()
                else:
                    write_folders(counted, INPUT, {i: output[i] for i in going if i not in there}, f"{self.out}/_{uuid.uuid4().hex}", self.options(step))
                for bin_ in told.get["n"] or []:
                    rows_out[int(bin_["x"])] = int(bin_["y"])
                for i in there:
                    status[i], message[i] = "skipped", "the output is there already"
            elif step["kind"] != "reparse":
                df = apply_step(df, step)
                sorted_by_input = sorted_by_input or step["kind"] == "sort"
            done.append(step["kind"])
        for i in failed:
            status[i], message[i] = "failed", failed[i]
        return {p: (p, output[i], status[i], n, rows_out[i], issues[i], steps_of[i] if i in failed else list(done), message[i]) for i, (p, _, n) in enumerate(inputs)}


def _exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's file systems, so that any store that Spark writes to counts."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
