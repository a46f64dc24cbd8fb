"""Whole jobs over files: pairs of flaw and fix, their line signatures, and functions that match them.

Lines are compared in abstracted form, so that a copy with other names is found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.functions import abstraction, lines
from twinseek.functions.text import bare, normal
from twinseek.operators import graph, match
from twinseek.sources import readers

Abstract = Callable[[Column], Column]


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of flaws and fixes with their order."""
    return readers.numbered_lines(spark, path, readers.PAIRS).withColumn("ord", F.struct("file", "line_number"))


def pairs(spark: SparkSession, path: str, introducing: str | None = None) -> DataFrame:
    """(sig_id, commit_id, project, cve, fd, fp, fo, introduced) of JSON lines: each flaw with the first fix of its
    commit and the last introducing function, or itself. Flaws without a fix, and pairs without code, go."""
    rows = records(spark, path).filter("commit_id <> ''")
    fixes = rows.filter("target = 0").groupBy("commit_id").agg(F.min_by("func", "ord").alias("fp"))
    flaws = rows.filter("target = 1").select(F.concat_ws("#", "commit_id", "line_number").alias("sig_id"), "commit_id", "project", "cve", F.col("func").alias("fd"))
    both = flaws.join(fixes, "commit_id").filter("fd <> '' and fp <> ''")
    if introducing is None:
        return both.withColumn("fo", F.col("fd")).withColumn("introduced", F.lit(False))
    old = readers.numbered_lines(spark, introducing, "commit_id string, introducing_func_code string").withColumn("ord", F.struct("file", "line_number"))
    has = old.groupBy("commit_id").agg(F.max_by("introducing_func_code", "ord").alias("_code")).select("commit_id", (F.trim("_code") != "").alias("introduced"))
    return match.with_oldest(both, old).join(has, "commit_id", "left").withColumn("introduced", F.coalesce("introduced", F.lit(False)))


def pairing(rows: DataFrame) -> DataFrame:
    """A10: (records, without_commit, commits, without_flaw, without_fix, pairs) of records (commit_id, target)."""
    known = rows.filter("commit_id <> ''").groupBy("commit_id").agg(F.count_if(F.col("target") == 1).alias("v"), F.count_if(F.col("target") == 0).alias("f"))
    both = known.agg(
        F.count("*").alias("commits"), F.count_if(F.col("v") == 0).alias("without_flaw"), F.count_if((F.col("v") > 0) & (F.col("f") == 0)).alias("without_fix"),
        F.coalesce(F.sum(F.when(F.col("f") > 0, F.col("v"))), F.lit(0)).alias("pairs"),
    )
    first = rows.agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.col("commit_id") == "", F.lit(True))).alias("without_commit"))
    return first.crossJoin(both)  # one row each


def codes_of(given: list[str | None]) -> list[str]:
    """Codes of a graph as lines: without comments, normalised, long enough."""
    return [y for x in given if x is not None and len(y := normal(bare(x))) >= lines.LEAST]


def essential_lines(fo: list[str], fd: list[str], fp: list[str]) -> tuple[list[str], list[str]]:
    """E1, E2 of line sets: (ev, ep)."""
    old, new, fixed = set(fo), set(fd), set(fp)
    return [x for x in fd if x not in fixed and (not fo or x in old)], [x for x in fp if x not in new and x not in old]


def essential(functions: DataFrame) -> DataFrame:
    """Functions with the line sets fo_set, fd_set, fp_set and the essential lines ev, ep."""

    def of(*texts):
        sets = [lines.set_of(t or "") for t in texts]
        return (*sets, *essential_lines(*sets))

    kind = "struct<" + ",".join(f"{c}:array<string>" for c in ("fo_set", "fd_set", "fp_set", "ev", "ep")) + ">"
    return functions.select("*", F.inline(F.array(F.udf(of, kind, useArrow=False)("fo", "fd", "fp"))))


def with_graphs(functions: DataFrame, graphs: DataFrame) -> DataFrame:
    """Functions (sig_id, fo, fd, fp) with `dependencies` of the essential lines in fd, `fix_dependencies` in fp, and
    the `control` statements of fd. graphs: (sig_id, side, pos, line), the tool's lines of each function, side fd or fp."""
    sets = essential(functions).select("sig_id", F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("code"), F.col(e).alias("own")) for side, e in (("fd", "ev"), ("fp", "ep"))))).alias("x")).select("sig_id", "x.*")
    key = F.struct("sig_id", "side").alias("key")
    asked = sets.select(key, "code", F.explode("own").alias("norm")).select("key", lines.original_line(F.coalesce("code", F.lit("")), F.col("norm")).alias("line")).filter("line is not null")
    table = graph.edges(graphs.select(key, "pos", "line"))
    near = graph.neighbours(table, asked).filter("kind in ('control', 'data')").groupBy("key.sig_id").agg(
        *(F.collect_set(F.when(F.col("key.side") == side, F.col("code"))).alias(name) for side, name in (("fd", "dependencies"), ("fp", "fix_dependencies")))
    )
    control = graph.control_statements(table.filter("key.side = 'fd'")).groupBy("key.sig_id").agg(F.collect_set("code").alias("control"))
    return functions.join(near, "sig_id", "left").join(control, "sig_id", "left")


def signatures(functions: DataFrame, abstract: Abstract = abstraction.abstracted_by_patterns) -> DataFrame:
    """Signatures of functions (sig_id, fo, fd, fp).

    Parts ev, dv, fv, ep and dp are lines {norm, abst}. sv and sp are the abstracted lines that functions are held against, sp
    of the essential lines only and without lines of sv; fo and fd the abstracted lines of the whole functions. Arrays
    `dependencies`, `fix_dependencies` and `control`, as with_graphs() makes them, add lines where the columns are there. A flaw
    without lines of its own and without lines of its fix is kept as failed. Other columns stay.
    """
    none = F.array().cast("array<string>")
    given = [c for c in ("dependencies", "fix_dependencies", "control") if c in functions.columns]
    keep = [c for c in functions.columns if c not in ("fo", "fd", "fp", *given)]
    body = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = functions.select(
        *keep, *(body(c).alias(c) for c in ("fo", "fd", "fp")), *(abstract(body(c)).alias(f"{c}_abst") for c in ("fo", "fd", "fp")),
        *((F.coalesce(F.col(c), none) if c in given else none).alias(f"_{c}") for c in ("dependencies", "fix_dependencies", "control")),
    )
    return texts.select(*keep, F.inline(F.array(F.udf(_signature, SIGNATURE, useArrow=False)("fo", "fd", "fp", "fo_abst", "fd_abst", "fp_abst", "_dependencies", "_fix_dependencies", "_control"))))


PARTS, COUNTS = ("ev", "dv", "fv", "ep", "dp"), ("n_ev", "n_dv", "n_fv", "n_ep", "n_dp")
SIGNATURE = "struct<" + ",".join([*(f"{c}:array<struct<norm:string,abst:string>>" for c in PARTS), *(f"{c}:array<string>" for c in ("sv", "sp", "fo", "fd")), *(f"{c}:int" for c in COUNTS), "processing_status:string"]) + ">"


def _signature(fo: str, fd: str, fp: str, fo_abst: str, fd_abst: str, fp_abst: str, dependencies: list, fix_dependencies: list, control: list) -> tuple:
    """The SIGNATURE of one function."""
    fo_set, fd_set, fp_set = (lines.set_of(t) for t in (fo, fd, fp))
    ev, ep = essential_lines(fo_set, fd_set, fp_set)
    own, asked, fixed, statements = set(fd_set), codes_of(dependencies), codes_of(fix_dependencies), set(codes_of(control))
    around = [x for x in fo_set if x in own] if fo_set else fd_set
    dv = [x for x in around if any(d in x for d in asked)] if ev else []
    dp = [x for x in fp_set if any(d in x for d in fixed)] if ep else []
    of_flaw, of_fix = abstraction.mapped_lines(fd, fd_abst), abstraction.mapped_lines(fp, fp_abst)
    parts = [abstraction.abstracted_lines(part, side) for part, side in ((ev, of_flaw), (dv, of_flaw), ([x for x in around if x in statements], of_flaw), (ep, of_fix), (dp, of_fix))]
    sv = list(dict.fromkeys(abst for part in parts[:3] for _, abst in part))
    flaw = set(sv)
    sp = list(dict.fromkeys(abst for _, abst in parts[3] if abst not in flaw))
    whole = (list(dict.fromkeys(lines.list_of(t))) for t in (fo_abst, fd_abst))
    return (*parts, sv, sp, *whole, *map(len, parts), "success" if ev or ep else "failed")


def targets_of(functions: DataFrame, abstract: Abstract = abstraction.abstracted_by_patterns) -> DataFrame:
    """(target_id, lines), abstracted lines of functions (target_id, function); those without a line go."""

    def of(text: str) -> list[tuple]:
        own = list(dict.fromkeys(lines.list_of(text)))
        return [(own,)] if own else []

    texts = functions.select("target_id", abstract(F.coalesce("function", F.lit(""))).alias("abst"))
    return texts.select("target_id", F.inline(F.udf(of, "array<struct<lines:array<string>>>", useArrow=False)("abst")))


def detect(signed: DataFrame, targets: DataFrame, theta: float = 0.5) -> DataFrame:
    """(sig_id, target_id, score) of targets (target_id, lines) by the more alike of both reference sets."""
    live = signed.filter("processing_status = 'success'").select("sig_id", "sv", "sp", F.array("fo", "fd").alias("refs"))
    return match.best_match(live, targets, theta)


def conditions(signed: DataFrame, targets: DataFrame, theta: float = 0.5) -> DataFrame:
    """How many pairs of a signature and a target pass each condition."""
    return match.condition_counts(signed.filter("processing_status = 'success'"), targets, theta)


def summary(signed: DataFrame) -> DataFrame:
    """Signatures made and failed, sums of their lines, and how many of them have an introducing function."""
    made = F.col("processing_status") == "success"
    sums = (F.coalesce(F.sum(F.when(made, F.col(c))), F.lit(0)).alias(c) for c in ("n_ev", "n_dv", "n_fv", "n_ep", "n_dp"))
    old = F.col("introduced") if "introduced" in signed.columns else F.lit(False)
    return signed.agg(F.count_if(made).alias("made"), F.count_if(~made).alias("failed"), *sums, F.count_if(made & old).alias("introducing"), F.count_if(made & ~old).alias("current"))
