"""Audit of source files: sizes, functions, patterns, include graphs and roll-ups.

A table of files has ``path`` and ``text``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.sources.scratch import fresh_folder

BRANCHES = ("if", "for", "while", "case", "catch", "except", "and", "or", "&&", "||")
# Words and calls that a review looks at, and their weights.
TODO = r"(?i)\b(TODO|FIXME|HACK|XXX)\b"
C_CALLS = ("strcpy", "strcat", "sprintf", "vsprintf", "gets", "scanf", "sscanf", "fscanf", "memcpy", "memmove")
CPP_PATTERNS = (r"\bnew\b", r"\bdelete\b", r"\breinterpret_cast<", r"\bconst_cast<")
PY_PATTERNS = (r"except\s*:\s*\n", r"except\s+Exception\s*:\s*\n", r"subprocess\.(Popen|run)\(", r"os\.system\(")
CRITICAL_WORDS = ("ControlGuard", "estop", "failsafe", "ttl", "armed", "set_all_mid", "setAllMid", "PWM", "thruster", "allocation", "ControlIntent", "Telemetry", "gcs")
WEIGHTS = {"todo": 5, "unsafe_c": 8, "unsafe_cpp": 6, "unsafe_py": 6}
INCLUDE = r'(?m)^\s*#include\s*[<"]([^>"]+)[>"]'


def file_sizes(files: DataFrame) -> DataFrame:
    """path, language, code, comment, blank, branches per file."""
    rows = files.withColumn("language", tx.language_of(F.col("path")))
    counts = F.when(F.col("language") == "python", tx.line_counts(F.col("text"), "python"))
    for language in ("cpp", "shell", "yaml"):
        counts = counts.when(F.col("language") == language, tx.line_counts(F.col("text"), language))
    rows = rows.withColumn("lines", counts.otherwise(tx.line_counts(F.col("text"), "other")))
    return rows.select("path", "language", (F.col("lines.n") - F.col("lines.comment") - F.col("lines.blank")).alias("code"), "lines.comment", "lines.blank", tx.branch_tokens(F.col("text"), BRANCHES).alias("branches"))


def risk_score(code: Column, longest: Column, nest: Column, branches: Column, comment: Column) -> Column:
    """Grows with size, the longest function, nesting and branches; files over 200 lines with few comments get 200 more."""
    sparse = (code > 200) & (comment < 0.05 * (code + comment))
    return code + 15 * longest + 40 * nest + 8 * branches + F.when(sparse, 200).otherwise(0)


def pattern_counts(text: Column, language: Column) -> dict[str, Column]:
    """Hits of each group of patterns: C and C++ ones in C++ files alone, Python ones in Python files, words everywhere."""
    total = lambda patterns: sum((tx.matches(text, p) for p in patterns), F.lit(0))
    only = lambda kind, c: F.when(language == kind, c).otherwise(0)
    return {
        "todo": tx.matches(text, TODO), "unsafe_c": only("cpp", tx.matches(text, rf"\b(?:{'|'.join(C_CALLS)})\b")), "unsafe_cpp": only("cpp", total(CPP_PATTERNS)),
        "unsafe_py": only("python", total(PY_PATTERNS)), "critical": total(re.escape(w) for w in CRITICAL_WORDS),
    }


def pattern_hits(files: DataFrame) -> DataFrame:
    """path, hits of each group and the weighted score, 1 more where any critical word is; files without text are left out."""
    hits = pattern_counts(F.col("text"), tx.language_of(F.col("path")))
    rows = files.filter(F.length("text") > 0).select("path", *(c.alias(n) for n, c in hits.items()))
    return rows.withColumn("score", sum((F.col(n) * w for n, w in WEIGHTS.items()), F.when(F.col("critical") > 0, 1).otherwise(0)))


def include_edges(files: DataFrame) -> DataFrame:
    """(module, target, n): includes between top directories."""
    edges = files.select(tx.top_directory(F.col("path")).alias("module"), F.explode(tx.extracted(F.col("text"), INCLUDE)).alias("header"))
    return edges.select("module", tx.top_directory(F.col("header")).alias("target")).groupBy("module", "target").agg(F.count("*").alias("n"))


def include_matrix(edges: DataFrame, modules: Sequence[str] | None = None) -> DataFrame:
    """Edges as a dense table with 0 for none; with ``modules`` no pass is needed to find the columns."""
    pivot = edges.groupBy("module").pivot("target", list(modules)) if modules else edges.groupBy("module").pivot("target")
    return pivot.agg(F.sum("n")).fillna(0)


def graph_text(edges: DataFrame, most: int = 100_000) -> str:
    """DOT text of a module graph; ValueError if it has more than ``most`` edges, which is no picture any more."""
    rows = edges.orderBy("module", "target").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the graph has more than {most} edges")
    body = "".join(f'  "{r.module}" -> "{r.target}" [label="{r.n}"];\n' for r in rows)
    return f"digraph includes {{\n{body}}}\n"


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """Simple cycles of at least three modules, each once, from its least module: joins of paths with edges.

    Paths only grow through modules greater than their first, so their number stays that of the
    cycles' prefixes. They grow until none is left, or to ``longest`` modules if that is given.
    Each length is written, as the number of steps isn't known before.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        folder = fresh_folder(spark, "cycles")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    steps = kept(edges.select("module", "target").filter("module <> target").distinct())
    paths = kept(steps.filter("target > module").select(F.col("module").alias("first"), F.col("target").alias("last"), F.array("module", "target").alias("path")))
    found, length = spark.createDataFrame([], "cycle string, length int"), 2
    while (longest is None or length <= longest) and not paths.isEmpty():
        grown = paths.join(steps, F.col("last") == F.col("module"))
        if length >= 3:
            found = found.unionByName(grown.filter(F.col("target") == F.col("first")).select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length")))
        grown = grown.filter((F.col("target") > F.col("first")) & ~F.array_contains("path", F.col("target")))
        paths, length = kept(grown.select("first", F.col("target").alias("last"), F.concat("path", F.array("target")).alias("path"))), length + 1
    return found.distinct()


def directory_rollup(sizes: DataFrame, depth: int) -> DataFrame:
    rows = sizes.groupBy(tx.directory_key(F.col("path"), depth).alias("directory"))
    return rows.agg(F.count("*").alias("files"), F.sum("code").alias("code"), F.max("code").alias("largest"), F.sum("branches").alias("branches"))


_PY_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+(\w+)")
_CPP_DEF = re.compile(r"^[\w:<>,&*~\s]+?\b([\w:~]+)\s*\([^;]*\)\s*(?:const)?\s*(?:noexcept)?\s*(?:\{.*)?$")


def spans_of(text: str, language: str) -> list[tuple[str, int, int, int]]:
    """(name, first line, lines, deepest nesting) of the functions of one file."""
    rows, out = text.split("\n"), []
    if language == "python":
        heads = [(i, m) for i, line in enumerate(rows) if "def" in line and (m := _PY_DEF.match(line))]
        for n, (i, m) in enumerate(heads):
            end = heads[n + 1][0] if n + 1 < len(heads) else len(rows)
            body = [line for line in set(rows[i + 1 : end]) if line.strip()]
            deep = max([(len(x) - len(x.lstrip())) // 4 for x in body] or [0]) - len(m[1]) // 4
            out.append((m[2], i + 1, end - i, max(0, deep)))
    elif language == "cpp":
        i = 0
        while i < len(rows):
            m = _CPP_DEF.match(rows[i])
            at = next((j for j in (i, i + 1) if j < len(rows) and "{" in rows[j]), None) if m else None
            if at is None:
                i += 1
                continue
            depth = deep = 0
            for j in range(at, len(rows)):
                for c in rows[j]:
                    depth += (c == "{") - (c == "}")
                    deep = max(deep, depth)
                if depth <= 0:
                    break
            out.append((m[1], i + 1, j - i + 1, max(0, deep - 1)))
            i = j + 1
    return out


def function_spans(files: DataFrame) -> DataFrame:
    """(path, name, line, lines, nest) of each function; files are read one by one inside the tasks."""

    def run(parts):
        for part in parts:
            rows = [(p, *s) for p, t, k in zip(part["path"], part["text"], part["language"]) for s in spans_of(t or "", k)]
            yield pd.DataFrame(rows, columns=["path", "name", "line", "lines", "nest"])

    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"), tx.language_of(F.col("path")).alias("language"))
    return rows.mapInPandas(run, "path string, name string, line long, lines long, nest long")


def long_functions(spans: DataFrame) -> DataFrame:
    limit = F.when(tx.language_of(F.col("path")) == "cpp", 120).otherwise(80)
    return spans.filter(F.col("lines") >= limit)


def hotspots(log: DataFrame, most: int = 200) -> DataFrame:
    """Changes per file from lines ``status<tab>path`` of a version log."""
    path = F.regexp_extract("value", r"^[AMDRC]\d*\t(.+)$", 1)
    return log.select(path.alias("path")).filter("path <> ''").groupBy("path").agg(F.count("*").alias("changes")).orderBy(F.desc("changes"), "path").limit(most)


def risk_table(files: DataFrame) -> DataFrame:
    """file_sizes with the longest function, the deepest nesting and the risk score of each file."""
    spans = function_spans(files).groupBy("path").agg(F.max("lines").alias("longest"), F.max("nest").alias("nest"))
    rows = file_sizes(files).join(spans, "path", "left").fillna(0, ["longest", "nest"])
    return rows.withColumn("score", risk_score(F.col("code"), F.col("longest"), F.col("nest"), F.col("branches"), F.col("comment")))


def directory_profile(files: DataFrame, changes: DataFrame, depth: int = 1) -> DataFrame:
    """directory, files, code, comment, code_pct, avg_risk, max_risk, todo, hits, changes, density: what a report says of each directory.

    ``changes`` (path, changes) are those of a version log. ``code_pct`` is the share of all code, ``density`` risk a line of code.
    """
    rows = risk_table(files).join(pattern_hits(files).select("path", "todo", F.col("score").alias("hits")), "path", "left").join(changes.select("path", "changes"), "path", "left")
    by = rows.groupBy(tx.directory_key(F.col("path"), depth).alias("directory"))
    out = by.agg(
        F.count("*").alias("files"), F.sum("code").alias("code"), F.sum("comment").alias("comment"), F.avg("score").alias("avg_risk"), F.max("score").alias("max_risk"),
        F.coalesce(F.sum("todo"), F.lit(0)).alias("todo"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("changes"), F.lit(0)).alias("changes"), F.sum("score").alias("_risk"),
    )
    whole = out.agg(F.sum("code").alias("_all"))  # one row
    share = F.when(F.col("_all") > 0, 100.0 * F.col("code") / F.col("_all")).otherwise(0.0)
    density = F.when(F.col("code") > 0, F.col("_risk") / F.col("code")).otherwise(0.0)
    return out.crossJoin(F.broadcast(whole)).withColumns({"code_pct": share, "density": density}).drop("_all", "_risk")


def language_breakdown(files: DataFrame) -> DataFrame:
    """language, files, code, comment, total, code_pct."""
    out = file_sizes(files).groupBy("language").agg(F.count("*").alias("files"), F.sum("code").alias("code"), F.sum("comment").alias("comment"), F.sum(F.col("code") + F.col("comment") + F.col("blank")).alias("total"))
    whole = out.agg(F.sum("code").alias("_all"))  # one row
    return out.crossJoin(F.broadcast(whole)).withColumn("code_pct", F.when(F.col("_all") > 0, 100.0 * F.col("code") / F.col("_all")).otherwise(0.0)).drop("_all")


def report_tables(files: DataFrame, changes: DataFrame, most: int = 20) -> dict[str, DataFrame]:
    """The tables of the audit's report by title; of files, functions and dense directories the first ``most``."""
    profile, risks = directory_profile(files, changes), risk_table(files)
    return {
        "Language Breakdown": language_breakdown(files).orderBy(F.desc("code"), "language"),
        "LOC by Top-level Directory": profile.select("directory", "code", "code_pct").orderBy(F.desc("code"), "directory"),
        "Directory Risk Profile": profile.select("directory", "files", "code", "comment", "code_pct", "avg_risk", "max_risk", "todo", "changes").orderBy(F.desc("code"), "directory"),
        "High-risk Directories by Risk Density": profile.filter("code >= 200").select("directory", "code", "density", "hits", "changes").orderBy(F.desc("density"), "directory").limit(most),
        "Top Risk Files": risks.select("path", "language", "code", "comment", "longest", "nest", "branches", "score").orderBy(F.desc("score"), "path").limit(most),
        "Long Functions": long_functions(function_spans(files)).select("path", "name", "line", "lines", "nest").orderBy(F.desc("lines"), "path", "line").limit(most),
        "Hotspots": changes.join(risks.select("path", "score"), "path").select("path", "changes", "score", (F.col("changes") * F.col("score")).alias("weight")).orderBy(F.desc("weight"), "path").limit(most),
    }
