"""Line sets of functions and their algebra, on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinseek.functions.abstraction import by_text
from twinseek.functions.text import bare, let, normal, normalize, strip, strip_comments

#: Shortest normalised line that counts.
LEAST = 15


def line_set(code: Column, least: int = LEAST) -> Column:
    """Distinct lines, each cleaned by itself, which drops leading braces."""
    return F.array_distinct(F.filter(F.transform(F.split(code, "\n"), lambda x: normalize(strip_comments(strip(x)))), lambda x: F.length(x) >= least))


def line_list(code: Column, least: int = LEAST) -> Column:
    """T4: lines of the whole cleaned function, which keeps braces, in order and with repetitions. T4a: array_distinct of it."""
    return F.filter(F.transform(F.split(strip_comments(code), "\n"), lambda x: normalize(strip(x))), lambda x: F.length(x) >= least)


def set_of(code: str, least: int = LEAST) -> list[str]:
    """line_set() of a plain value."""
    return list(dict.fromkeys(x for y in code.split("\n") if len(x := normal(bare(y.strip()))) >= least))


def list_of(code: str, least: int = LEAST) -> list[str]:
    """line_list() of a plain value."""
    return [x for y in bare(code).split("\n") if len(x := normal(y.strip())) >= least]


def original_line(code: Column, line: Column) -> Column:
    """T5: the first line of the code that is the given one when normalised, stripped."""
    both = F.struct(F.transform(F.split(code, "\n"), strip).alias("all"), line.alias("line"))
    return let(both, lambda b: F.get(F.filter(b["all"], lambda x: normalize(strip_comments(x)) == b["line"]), F.lit(0)))


def context(fo: Column, fd: Column) -> Column:
    """Lines of both the oldest and the disclosed function; of the disclosed one where the oldest has none."""
    return F.when(F.size(fo) > 0, F.array_intersect(fo, fd)).otherwise(fd)


def essential_vulnerable(fo: Column, fd: Column, fp: Column) -> Column:
    """E1."""
    return F.array_intersect(F.array_except(fd, fp), context(fo, fd))


def essential_patch(fo: Column, fd: Column, fp: Column) -> Column:
    """E2."""
    return F.when(F.size(fo) > 0, F.array_except(F.array_except(fp, fd), F.array_union(fo, fd))).otherwise(F.array_except(fp, fd))


def dependent(lines: Column, dependencies: Column) -> Column:
    """Lines that hold one of the dependencies."""
    return by_text(lambda own, deps: [x for x in own if any(d in x for d in deps)], "array<string>")(lines, dependencies)


def control_flow(lines: Column, statements: Column) -> Column:
    """Lines that are a control-flow statement."""
    return F.array_intersect(lines, statements)


def signature(ev: Column, dv: Column, fv: Column, ep: Column) -> tuple[Column, Column]:
    """(lines of the flaw, lines of the patch without them)."""
    sv = F.array_union(F.array_union(ev, dv), fv)
    return sv, F.array_except(ep, sv)


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def matches(sv: Column, sp: Column, target: Column, score: Column, theta: float = 0.5) -> Column:
    """All lines of the flaw, none of the patch, alike enough; a condition without lines is not asked."""
    first, second, third = F.size(F.array_except(sv, target)) == 0, ~F.arrays_overlap(sp, target), score >= theta
    return F.when(F.size(sp) == 0, first & third).when(F.size(sv) == 0, second & third).otherwise(first & second & third)


def reference_score(fo: Column, fd: Column, target: Column) -> Column:
    """the larger Jaccard of the two reference sets; an empty one scores 0."""
    of = lambda ref: F.when(F.size(ref) == 0, 0.0).otherwise(jaccard(ref, target))
    return F.greatest(of(fo), of(fd))


def long_enough(code: Column) -> Column:
    """more than two newlines after double ones are made single, once."""
    flat = F.replace(code, F.lit("\n\n"), F.lit("\n"))
    return F.length(flat) - F.length(F.replace(flat, F.lit("\n"), F.lit(""))) > 2
