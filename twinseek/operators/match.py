"""Joins of clones with what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinseek.functions.lines import jaccard, matches
from twinseek.functions.text import first_line
from twinseek.sources.scratch import scratch


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_")).select(*keys, *(F.col(f"_.{c}").alias(c) for c in rest))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the first in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_")).select(*keys, *(F.col(f"_.{c}").alias(c) for c in rest))


def hash_counts(known: DataFrame, targets: DataFrame, order: str) -> DataFrame:
    """Targets whose hash is known, once each, with the last known record and `times`, how often it is known."""
    rest = [c for c in known.columns if c != "hash"]
    table = known.groupBy("hash").agg(F.count("*").alias("times"), F.max_by(F.struct(*rest), order).alias("known"))
    return targets.join(table, "hash")


def hash_join(known: DataFrame, targets: DataFrame, order: str) -> DataFrame:
    """hash_counts() with a row for each time: as many rows as known and target copies multiply to."""
    return hash_counts(known, targets, order).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "_i")


def with_fix(vulnerable: DataFrame, fixes: DataFrame) -> DataFrame:
    """Vulnerable (vuln_id, body) with (fix_id, how): by equal body, else by the first line; of several the first.

    fixes has (fix_id, body), in the order of fix_id.
    """
    exact = fixes.groupBy("body").agg(F.min("fix_id").alias("_exact"))
    line = fixes.groupBy(first_line(F.col("body")).alias("_line")).agg(F.min("fix_id").alias("_first"))
    both = vulnerable.withColumn("_line", first_line(F.col("body"))).join(exact, "body", "left").join(line, "_line", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_first").isNotNull(), "first_line").otherwise("none")
    return both.select(*vulnerable.columns, F.coalesce("_exact", "_first").alias("fix_id"), how.alias("how"))


def fix_filter(scored: DataFrame) -> DataFrame:
    """(s_vuln, s_fix): kept where nearer to the flaw, or where no fix is known."""
    return scored.filter(F.col("s_fix").isNull() & F.col("fix_id").isNull() | (F.col("s_fix") < F.col("s_vuln")))


def filter_counts(scored: DataFrame) -> DataFrame:
    """(total, kept, removed) clones of fix_filter()."""
    kept = F.col("s_fix").isNull() & F.col("fix_id").isNull() | F.coalesce(F.col("s_fix") < F.col("s_vuln"), F.lit(False))
    return scored.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"))


def enrich(results: DataFrame, urls: DataFrame, paths: DataFrame) -> DataFrame:
    """Results (vuln_text, clone_text, ...) with the last commit_url of the flaw, or null, and the last path of the
    clone, without which they go. urls: (vuln_text, commit_url, ord); paths: (clone_text, path, ord)."""
    url = urls.groupBy("vuln_text").agg(F.max_by(F.struct("commit_url"), "ord").alias("_")).select("vuln_text", "_.commit_url")
    path = paths.groupBy("clone_text").agg(F.max_by(F.struct("path"), "ord").alias("_")).select("clone_text", "_.path").filter("path <> ''")
    return results.join(path, "clone_text").join(url, "vuln_text", "left")


def with_oldest(pairs: DataFrame, introducing: DataFrame) -> DataFrame:
    """Pairs (commit_id, fd, ...) with fo: the last introducing code of the commit, or the function itself."""
    old = introducing.groupBy("commit_id").agg(F.max_by("introducing_func_code", "ord").alias("_fo"))
    return pairs.join(old, "commit_id", "left").withColumn("fo", F.coalesce(F.when(F.trim("_fo") != "", F.col("_fo")), F.col("fd"))).drop("_fo")


def unprocessed(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key has no output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


#: A line is common if more than one of so many classes of targets have it; there are at most so many times a class's lines.
COMMON = 1024
#: Bounds are loosened by this, so that rounding loses no pair; scores decide.
LOOSE = 1e-9


def digests(lines: Column) -> Column:
    """Distinct lines as sorted MD5 digests: sets are held against each other without their texts."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(lines, lambda x: x.isNotNull()), lambda x: F.md5(x))))


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows that are used more than once, through files."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def same_sets(rows: DataFrame, sets: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """(class, *sets, w): rows whose arrays are equal, once, numbered whatever their ids are, and how many there are."""
    once = rows.groupBy(*sets).agg((F.count("*") if weight is None else F.sum(weight)).alias("w"))
    return kept(once.withColumn("class", F.monotonically_increasing_id()), name)


def first_lines(sets: DataFrame, counts: DataFrame, theta: float) -> DataFrame:
    """(id, n, i, line): of each set (id, lines) of n lines the first n - ceil(theta n) + 1 with their places, from rare to common
    by counts (line, c). Two sets of a Jaccard of theta have one of these in common."""
    lines = sets.select("id", F.size("lines").alias("n"), F.explode("lines").alias("line")).join(counts, "line", "left")
    placed = lines.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("c", F.lit(0)), "line")))
    return placed.filter(F.col("i") <= F.col("n") - F.ceil(F.lit(theta) * F.col("n") - LOOSE) + 1).select("id", "n", "i", "line")


def close(na: Column, ia: Column, nb: Column, ib: Column, theta: float) -> Column:
    """Whether sets of na and nb lines whose first line in common has the places ia and ib can have a Jaccard of theta."""
    sizes = (nb >= theta * na - LOOSE) & (na >= theta * nb - LOOSE)
    return sizes & (F.least(na - ia, nb - ib) + 1 >= (na + nb) * (theta / (1 + theta)) - LOOSE)


def near_sets(sets: DataFrame, others: DataFrame, theta: float) -> DataFrame:
    """(a, b): sets (id, lines) and others that may have a Jaccard of theta above 0, by an index of rare lines of both."""
    counts = others.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("c"))
    left, right = (first_lines(x, counts, theta).select("line", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "i"))) for x, side in ((sets, "a"), (others, "b")))
    met = left.join(right, "line").filter(close(F.col("n_a"), F.col("i_a"), F.col("n_b"), F.col("i_b"), theta))
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _classes(signatures: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures (sig_id, sv, sp, refs) and targets (target_id, lines) as digests, and the classes of equal ones."""
    signs = kept(signatures.select("sig_id", digests(F.col("sv")).alias("sv"), digests(F.col("sp")).alias("sp"), F.array_sort(F.array_distinct(F.transform("refs", digests))).alias("refs")), "signatures")
    there = kept(targets.select("target_id", digests(F.col("lines")).alias("lines")), "targets")
    return signs, there, same_sets(signs, ["sv", "sp", "refs"], "signature-classes"), same_sets(there, ["lines"], "target-classes")


def _alike(signs: DataFrame, there: DataFrame, theta: float) -> DataFrame:
    """(s, t, score, ws, wt, sv, sp, lines) of classes of signatures and of targets, of a score of at least theta above 0."""
    refs = signs.select(F.col("class").alias("s"), F.explode("refs").alias("lines")).filter(F.size("lines") > 0)
    sets = refs.groupBy("lines").agg(F.min("s").alias("id"))
    sets = kept(sets.select(F.monotonically_increasing_id().alias("id"), "lines"), "references")
    near = near_sets(sets, there.select(F.col("class").alias("id"), "lines"), theta)
    scored = near.join(sets.select(F.col("id").alias("a"), F.col("lines").alias("ref")), "a").join(there.select(F.col("class").alias("b"), F.col("lines"), F.col("w").alias("wt")), "b")
    scored = scored.withColumn("score", jaccard(F.col("ref"), F.col("lines"))).filter(F.col("score") >= theta)
    best = scored.join(refs.withColumnRenamed("lines", "ref"), "ref").groupBy("s", F.col("b").alias("t")).agg(F.max("score").alias("score"))
    both = best.join(signs.select(F.col("class").alias("s"), F.col("w").alias("ws"), "sv", "sp"), "s")
    return both.join(there.select(F.col("class").alias("t"), F.col("w").alias("wt"), "lines"), "t")


def _loose(signs: DataFrame, there: DataFrame, theta: float) -> DataFrame:
    """_alike() with a theta of 0 or less, which all pairs have: of signatures with lines of the flaw those with the rarest of
    them, of others all, in blocks. Pairs without all lines of the flaw may be left out."""
    lines = there.select(F.col("class").alias("t"), F.explode("lines").alias("line"))
    counts = lines.groupBy("line").agg(F.count("*").alias("c"))
    flaws = signs.filter(F.size("sv") > 0).select(F.col("class").alias("s"), F.explode("sv").alias("line")).join(counts, "line", "left").groupBy("s").agg(F.min_by("line", F.struct(F.coalesce("c", F.lit(0)), "line")).alias("line"))
    found = flaws.join(lines, "line").select("s", "t")
    packs = signs.filter(F.size("sv") == 0).groupBy(F.pmod(F.xxhash64("class"), F.lit(64)).alias("block")).agg(F.collect_list("class").alias("ids"))
    every = there.select(F.col("class").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("block")).join(packs, "block")
    found = found.unionByName(every.select(F.explode("ids").alias("s"), "t"))
    both = found.join(signs.select(F.col("class").alias("s"), F.col("w").alias("ws"), "sv", "sp", "refs"), "s").join(there.select(F.col("class").alias("t"), F.col("w").alias("wt"), "lines"), "t")
    zero = F.struct(F.lit(0.0).alias("score"), F.col("lines").alias("lines"))
    best = F.aggregate("refs", zero, lambda x, ref: F.struct(F.greatest(x["score"], F.when(F.size(ref) == 0, 0.0).otherwise(jaccard(ref, x["lines"]))).alias("score"), x["lines"].alias("lines")))["score"]
    return both.withColumn("score", best).filter(F.col("score") >= theta).drop("refs")


def best_match(signatures: DataFrame, targets: DataFrame, theta: float = 0.5) -> DataFrame:
    """(sig_id, target_id, score) by the most alike of several reference sets.

    signatures: (sig_id, sv, sp, refs), arrays of lines and an array of such arrays, sp without lines of sv; targets: (target_id,
    lines), sets. Equal ones are compared once. References and targets meet by their rare lines instead of all pairs, and where
    places and sizes allow the score; what they find is checked by the whole sets. With a theta of 0 or less a signature without
    lines of the flaw needs no line in common, and is held against all targets in blocks.
    """
    signs, there, sign_classes, target_classes = _classes(signatures, targets)
    found = (_alike if theta > 0 else _loose)(sign_classes, target_classes, theta)
    found = found.filter(matches(F.col("sv"), F.col("sp"), F.col("lines"), F.col("score"), theta)).select("s", "t", "score")
    members = lambda rows, classes, sets, id, to: rows.select(id, *sets).join(classes.select(F.col("class").alias(to), *sets), sets).select(id, to)
    found = found.join(members(signs, sign_classes, ["sv", "sp", "refs"], "sig_id", "s"), "s").join(members(there, target_classes, ["lines"], "target_id", "t"), "t")
    return found.select("sig_id", "target_id", "score")


def signature_match(signatures: DataFrame, targets: DataFrame, theta: float = 0.5) -> DataFrame:
    """best_match() of signatures (sig_id, sv, sp, ref) with one reference set."""
    return best_match(signatures.select("sig_id", "sv", "sp", F.array("ref").alias("refs")), targets, theta)


def _with_any(asked: DataFrame, there: DataFrame, lines: DataFrame, common: DataFrame) -> DataFrame:
    """(patched): over sets (id, lines, w) how many of the targets have one of a set's lines.

    Common lines are not joined with the targets that have them: targets are counted by which common lines they have, and so
    are the sets. Targets with a rare line of the set count where they have none of its common ones.
    """
    none = F.array().cast("array<int>")
    of = lambda rows, id: rows.join(F.broadcast(common), "line").groupBy(id).agg(F.array_sort(F.collect_list("k")).alias("own"))
    own_lines = asked.select("id", F.explode("lines").alias("line"))
    sets = asked.select("id", "w").join(of(own_lines, "id"), "id", "left").select("id", "w", F.coalesce("own", none).alias("own"))
    targets = there.select(F.col("class").alias("t"), F.col("w").alias("wt")).join(of(lines, "t"), "t", "left").select("t", "wt", F.coalesce("own", none).alias("has"))
    a = sets.filter(F.size("own") > 0).groupBy("own").agg(F.sum("w").alias("w")).select("own", "w", F.explode("own").alias("k"))
    b = targets.filter(F.size("has") > 0).groupBy("has").agg(F.sum("wt").alias("wt")).select("has", "wt", F.explode("has").alias("k"))
    some = a.join(b, "k").filter(F.col("k") == F.array_min(F.array_intersect("own", "has"))).agg(F.sum(F.col("w") * F.col("wt")).alias("x"))
    rare = own_lines.join(F.broadcast(common), "line", "left_anti").join(sets, "id")
    met = rare.join(lines.join(F.broadcast(common), "line", "left_anti").join(targets, "t"), "line").filter(~F.arrays_overlap("own", "has"))
    rest = met.groupBy("id", "t").agg((F.first("w") * F.first("wt")).alias("x")).agg(F.sum("x").alias("x"))
    return some.unionByName(rest).agg(F.coalesce(F.sum("x"), F.lit(0).cast("long")).alias("patched"))


def _with_all(asked: DataFrame, there: DataFrame, lines: DataFrame, counts: DataFrame, common: DataFrame) -> DataFrame:
    """(cond1): over sets (id, lines, w) how many of the targets have all of a set's lines: those that have the rarest one are
    asked, or, where that is common, what sets of common lines the targets have."""
    asked = asked.select("id", F.col("lines").alias("own"), "w")
    first = asked.select("id", F.explode("own").alias("line")).join(counts, "line", "left").groupBy("id").agg(F.min_by("line", F.struct(F.coalesce("c", F.lit(0)), "line")).alias("line"))
    first = first.join(F.broadcast(common), "line", "left").join(asked, "id")
    held = lambda rows: rows.filter(F.size(F.array_except("own", "lines")) == 0).agg(F.sum(F.col("w") * F.col("wt")).alias("x"))
    rare = held(first.filter("k is null").select("id", "own", "w", "line").join(lines, "line").join(there.select(F.col("class").alias("t"), F.col("w").alias("wt"), "lines"), "t"))
    sets = lines.join(F.broadcast(common), "line").groupBy("t").agg(F.array_sort(F.collect_list("line")).alias("lines")).join(there.select(F.col("class").alias("t"), F.col("w").alias("wt")), "t")
    sets = sets.groupBy("lines").agg(F.sum("wt").alias("wt")).select("lines", "wt", F.explode("lines").alias("line"))
    return rare.unionByName(held(first.filter("k is not null").select("own", "w", "line").join(sets, "line"))).agg(F.coalesce(F.sum("x"), F.lit(0).cast("long")).alias("cond1"))


def condition_counts(signatures: DataFrame, targets: DataFrame, theta: float = 0.5) -> DataFrame:
    """(cond1, cond2, cond3, all_conditions): how many pairs of a signature and a target pass each condition. The first is
    not asked of signatures without lines of the flaw, the second not of those without lines of the patch. Equal signatures, and
    targets, are counted together, from an index of lines; for the third, with a theta above 0, those that may be alike are looked at.

    signatures: (sig_id, sv, sp, fo, fd); targets: (target_id, lines).
    """
    _, _, signs, there = _classes(signatures.select("sig_id", "sv", "sp", F.array("fo", "fd").alias("refs")), targets)
    n = there.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.count("*").alias("classes"))
    lines = kept(there.select(F.col("class").alias("t"), F.explode("lines").alias("line")), "lines")
    counts = kept(lines.groupBy("line").agg(F.count("*").alias("c")), "line-counts")
    common = counts.crossJoin(n).filter(F.col("c") * COMMON > F.col("classes")).filter(F.col("c") > 1).select("line", F.row_number().over(Window.orderBy("line")).alias("k"))
    common = kept(common, "common-lines")
    sets = lambda c: same_sets(signs.filter(F.size(c) > 0), [c], f"classes-{c}", F.col("w")).select(F.col("class").alias("id"), F.col(c).alias("lines"), "w")
    first, patched = _with_all(sets("sv"), there, lines, counts, common), _with_any(sets("sp"), there, lines, common)
    asked = signs.agg(F.coalesce(F.sum(F.when(F.size("sp") > 0, F.col("w"))), F.lit(0)).alias("asked"), F.coalesce(F.sum("w"), F.lit(0)).alias("signs"))
    pairs, hit = F.col("ws") * F.col("wt"), matches(F.col("sv"), F.col("sp"), F.col("lines"), F.col("score"), theta)
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0).cast("long")).alias(name)
    third = (_alike if theta > 0 else _loose)(signs, there, theta).agg(total(pairs, "cond3"), total(F.when(hit, pairs), "all_conditions"))
    one = n.crossJoin(first).crossJoin(asked).crossJoin(patched).crossJoin(third)  # one row each
    cond3 = F.col("cond3") if theta > 0 else F.col("signs") * F.col("n")
    return one.select("cond1", (F.col("asked") * F.col("n") - F.col("patched")).alias("cond2"), cond3.alias("cond3"), "all_conditions")


def line_classes(rows: DataFrame) -> DataFrame:
    """(id, class_id, lines): rows (id, lines) whose line sets are equal have the smallest id of them as their class."""
    keyed = rows.withColumn("_k", F.sha2(F.array_join(F.sort_array("lines"), "\n"), 256))
    return keyed.join(keyed.groupBy("_k").agg(F.min("id").alias("class_id")), "_k").select("id", "class_id", "lines")


def jaccard_pairs(sets: DataFrame, theta: float) -> DataFrame:
    """(a, b, jaccard) for pairs a < b of sets (id, lines) of at least theta, without comparing all pairs.

    Lines are ordered from rare to common. Two sets alike enough share one of their first n - ceil(theta n) + 1 lines, so
    only those are joined; common lines are beyond them but in the smallest sets. Sizes, and the places of the first line in
    common, bound the rest, and what is left is counted exactly. Lines are digests, which are made once.
    """
    sets = kept(sets.select("id", digests(F.col("lines")).alias("lines")), "sets")
    near = near_sets(sets, sets, theta).filter("a < b")
    both = near.join(sets.select(F.col("id").alias("a"), F.col("lines").alias("la")), "a").join(sets.select(F.col("id").alias("b"), F.col("lines").alias("lb")), "b")
    shared = F.size(F.array_intersect("la", "lb"))
    return both.select("a", "b", (shared / (F.size("la") + F.size("lb") - shared)).alias("jaccard")).filter(F.col("jaccard") >= theta)


def active(key: str, rows: DataFrame, when: str, hit: Column, since: Column, least: float = 0.1) -> DataFrame:
    """(key, rate, last): keys with a recent row and a large enough share of hits."""
    found = rows.groupBy(key).agg((F.count_if(hit) / F.count("*")).alias("rate"), F.max(when).alias("last"))
    return found.filter((F.col("rate") >= least) & (F.col("last") >= since))
