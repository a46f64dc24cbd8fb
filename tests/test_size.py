"""What queries must not do if they are to grow with their input: deal rows anew, hold all of a batch, repeat work."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from twinseek.functions import abstraction, lines, text
from twinseek.operators import graph, match, vectors
from twinseek.plans import catalogue, code_queries, detection

SF = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["graph_neighbours", "graph_edges", "graph_control"])
def test_graphs_stay_where_they_are_made(spark, name):
    """A function's graph needs no window, join or grouping over all edges."""
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert not any(step in text for step in ("Window", "Join", "Aggregate", "Generate")), text


def test_graphs_of_one_function_are_those_of_the_table(spark):
    rng = random.Random(3)
    names = ["a b", "RET", "", "x__y", "typedef z", "Abc", "abcd", "\\", "total = b c", "None", "d\te"]
    made = []
    for key in range(6):
        for pos in range(60):
            line = rng.choice([":".join([rng.choice(graph.KINDS + ["X"]), rng.choice(["3", "No", "12"]), rng.choice(names), rng.choice(["CONTROL_STRUCTURE", "CALL"]), rng.choice(["5", ""]), rng.choice(names), "L:M"]), " EDGES_START", "EDGES_END\t", "AST:1:b"])
            made.append((key, pos, line))
    asked = [(key, rng.choice(["bc", "ABCD", "\\\\", "", "q abcd e", None])) for key in range(5) for _ in range(2)]
    table = graph.edges(spark.createDataFrame(made, "key int, pos int, line string")).cache()
    by_key = lambda rows: {k: {tuple(r)[1:] for r in rows if r[0] == k} for k in range(6)}
    got, near, control, distinct = (by_key(f.collect()) for f in (table.drop("pos"), graph.neighbours(table, spark.createDataFrame(asked, "key int, line string")), graph.control_statements(table), graph.distinct_edges(table).drop("pos")))
    ends = graph.ends_of
    for key in range(6):
        own = graph.edges_in(line for k, _, line in made if k == key)
        assert set(own) == got[key]
        flat = lambda x: "".join(x.split()).lower()
        lines = [x for k, x in asked if k == key]
        same = lambda x, c: bool(x and c) and (flat(x).strip("\\") in flat(c) or flat(c) in flat(x).strip("\\"))
        touching = {at for _, at, _ in ends(own) if any(same(x, at) for x in lines)}
        assert near[key] == {(kind, code) for kind, at, code in ends(own) if at in touching and code not in touching and not graph.is_system(code)}
        assert {(c,) for c in graph.control_in(own)} == control[key]
        assert len(graph.distinct_in(own)) == len(distinct[key])
    system = spark.createDataFrame([(n,) for n in names + [None, "　"]], "c string").select("c", graph.system_code(F.col("c"))).collect()
    assert all(graph.is_system(c) == is_system for c, is_system in system)


@pytest.mark.parametrize("few", [0, 12])
def test_names_are_replaced_alike_by_either_way(monkeypatch, few):
    monkeypatch.setattr(abstraction, "FEW", few)
    rng = random.Random(9)
    for _ in range(400):
        code = "".join(rng.choice(["of", "in", "L", "of", "_", "é", " ", ".", "\n", "o"]) for _ in range(rng.randrange(20)))
        want = code
        for name in ("of", "in", "L"):
            want = re.sub(rf"(^|\W){name}(\W)", r"\g<1>L\g<2>", want)
        assert abstraction.in_turn(code, ["of", "in", "L"], "L") == want


def test_texts_reach_python_in_small_packs(spark):
    """What a batch of texts takes must not grow with the rows of a partition."""
    rows = spark.range(4000, numPartitions=1).select(F.concat(F.lit("x of "), F.col("id").cast("string")).alias("s"))
    for made in (abstraction.rename_tokens(F.col("s")), abstraction.line_map(F.col("s"), F.col("s")), abstraction.replace_in_turn(F.col("s"), F.array(F.lit("of")), "P")):
        assert "ArrowEvalPython" not in rows.select(made)._jdf.queryExecution().executedPlan().toString()


def test_plain_lines_are_those_of_columns(spark):
    rng = random.Random(4)
    parts = ["{{a long line of code }", "// gone", "/* gone */", "'a // stays' and more", '"x /* y"', "\n", "\n", " ", "\t", "\x1f", "　", "}", "\\", "Ü and ΑΣ ", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(300)] + ["", "{}{}", "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", lines.line_set(F.col("s"), 3), lines.line_list(F.col("s"), 3), text.strip_comments(F.col("s"))).collect()
    for s, line_set, line_list, bare in rows:
        assert (line_set, line_list, bare) == (lines.set_of(s, 3), lines.list_of(s, 3), text.bare(s))


@pytest.mark.parametrize("held", [8192, 3])
def test_pairs_of_vectors_are_counted_once(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "HELD", held)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(rng.choice([3, 3, 4]))], rng.choice([0, 1, None])) for i in range(30)] + [(99, None, 1), (98, [float("nan"), 1.0, 1.0], 1)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if any(a) and any(b) and len(a) == len(b) else -9
    pairs = [(a, b) for a in rows[:30] for b in rows[:30] if a[0] < b[0] and cos(a[1], b[1]) >= 0.35 and None not in (a[2], b[2])]
    got = vectors.pair_counts(spark.createDataFrame(rows, "id long, v array<double>, label int"), 0.35)
    assert tuple(got.first()) == (sum(a[2] == b[2] for a, b in pairs), sum(a[2] != b[2] for a, b in pairs))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and "Join" not in text


@pytest.mark.parametrize("sent", [50_000, 0])
def test_second_vectors_are_not_joined_to_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(vectors, "SENT", sent)
    monkeypatch.setattr(vectors, "HELD", 2)
    rows = [(1, [1.0, 0.2]), (2, [0.9, 0.1]), (3, [1.0, 0.2]), (4, [0.0, 0.0]), (5, [0.5, 0.5]), (6, [3.0, 0.6])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.2], [1.0, 0.2]), (2, [0.9, 0.1], None), (5, [0.5, 0.5], [0.0, 1.0])], "id long, v array<double>, beside array<double>")
    found = vectors.similar(asked, table, threshold=0.5, beside=True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["query_id"], r["id"]): r for r in found.collect()}
    assert set(got) == {(q, i) for q in (1, 2, 5) for i in (1, 2, 3, 5, 6) if q != i}
    assert all(r["beside"] == r["similarity"] for (q, _), r in got.items() if q == 1) and all(r["beside"] is None for (q, _), r in got.items() if q == 2)
    assert got[5, 1]["beside"] == pytest.approx(0.2 / math.hypot(1, 0.2))


@pytest.mark.parametrize("name", ["signature_summary", "signature_parts", "signatures_roundtrip"])
def test_signatures_are_made_once_in_small_packs(spark, name):
    """One pass of Python over a flaw's texts: no Arrow batches of them, and no patterns that are applied anew for every use."""
    made = ({**catalogue.QUERIES, "signatures_roundtrip": code_queries._signed}[name])(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in made and "regexp" not in made


def test_signatures_of_one_function_are_those_of_columns(spark):
    """What is written and read again is what the parts' own column functions say."""
    rng = random.Random(6)
    some = ["if (total > limit_of(x)) {", "// of the comment here", "copy_all(buffer, of the total);", "return of the that and is;", "{ int total_count = 0; }", "'a // literal of the'", ""]
    rows = [(i, *("\n".join(rng.choice(some) for _ in range(rng.randrange(9))) for _ in range(3)), ["if (total > limit_of(x", None]) for i in range(60)]
    functions = spark.createDataFrame(rows, "sig_id int, fo string, fd string, fp string, dependencies array<string>")
    got = {r["sig_id"]: r for r in detection.signatures(functions, code_queries.fixed_abstract).collect()}
    sets = functions.select("sig_id", *(lines.line_set(F.col(c)).alias(c) for c in ("fo", "fd", "fp")))
    fo, fd, fp = (F.col(c) for c in ("fo", "fd", "fp"))
    for r in sets.select("sig_id", lines.essential_vulnerable(fo, fd, fp).alias("ev"), lines.essential_patch(fo, fd, fp).alias("ep"), lines.context(fo, fd).alias("around")).collect():
        mine = got[r["sig_id"]]
        assert [x["norm"] for x in mine["ev"]] == r["ev"] and [x["norm"] for x in mine["ep"]] == r["ep"]
        assert [x["norm"] for x in mine["dv"]] == ([x for x in r["around"] if "if(total>limit_of(x" in x] if r["ev"] else []) and mine["n_dv"] == len(mine["dv"])
        assert mine["processing_status"] == ("success" if r["ev"] or r["ep"] else "failed") and not set(mine["sv"]) & set(mine["sp"])


def test_sets_with_a_common_line_do_not_all_meet(spark):
    """Sets of a common line and one of their own cannot be alike by half, and meet none but themselves."""
    sets = spark.createDataFrame([(i, ["license", f"own {i}"]) for i in range(200)], "id int, lines array<string>")
    assert {tuple(r) for r in match.near_sets(sets, sets, 0.5).collect()} == {(i, i) for i in range(200)}


def test_equal_targets_are_compared_once(spark):
    """Of equal signatures, and equal targets, one is compared; all are told."""
    signs = spark.createDataFrame([(i, ["a"], ["z"], [["a", "b"], ["b"]]) for i in range(5)], "sig_id int, sv array<string>, sp array<string>, refs array<array<string>>")
    targets = spark.createDataFrame([(i, ["b", "a"][:: 1 if i % 2 else -1]) for i in range(7)] + [(7, ["a", "b", "z"])], "target_id int, lines array<string>")
    for theta in (0.5, 0.0):
        assert sorted(map(tuple, match.best_match(signs, targets, theta).collect())) == [(s, t, 1.0) for s in range(5) for t in range(7)]
    _, _, sign_classes, target_classes = match._classes(signs, targets)
    assert [r["w"] for r in sign_classes.collect()] == [5] and sorted(r["w"] for r in target_classes.collect()) == [1, 7]


def test_conditions_are_asked_of_all_flaws(spark):
    """no flaw is left out, in the query as in its SQL."""
    signed, _ = code_queries._detectable(spark, SF)
    ids = {r[0] for r in signed.select("sig_id").collect()}
    docs = {r[0] for r in catalogue.table(spark, SF, "documents").select("doc_id").collect()}
    assert ids == {d for d in docs if d + 1 in docs and d + 2 in docs} and "% 20" not in code_queries.ORACLE_SQL["detection_conditions"]


@pytest.mark.parametrize("common", [1, 8, 1024])
def test_conditions_are_those_of_all_pairs(spark, monkeypatch, common):
    """Common lines are counted by the sets of them that targets have, whatever counts as common."""
    monkeypatch.setattr(match, "COMMON", common)
    rng = random.Random(common)
    names = [f"line {i}" for i in range(9)]
    some = lambda n: rng.sample(names, min(rng.randrange(n), 1 + int(rng.expovariate(1))))
    signs = []
    for i in range(50):
        sv = some(4)
        signs.append((i % 45, sv, [x for x in some(5) if x not in sv], some(8), some(8)))
    targets = [(i, some(9)) for i in range(70)]
    signed = spark.createDataFrame(signs, "sig_id int, sv array<string>, sp array<string>, fo array<string>, fd array<string>")
    there = spark.createDataFrame(targets, "target_id int, lines array<string>")
    for theta in (0.5, 0.3, 0.0):
        want = [0, 0, 0, 0]
        for _, sv, sp, *refs in signs:
            for _, own in targets:
                score = max(len(set(ref) & set(own)) / len(set(ref) | set(own)) if ref else 0.0 for ref in refs)
                first, second, third = set(sv) <= set(own), not set(sp) & set(own), score >= theta
                for i, held in enumerate((sv and first, sp and second, third, third and (first if not sp else second if not sv else first and second))):
                    want[i] += bool(held)
        assert list(match.condition_counts(signed, there, theta).first()) == want


def test_preprocessed_texts_are_those_of_columns(spark):
    rng = random.Random(8)
    parts = ["IF", "If", "if", "iF_x", "String", "éIF", " ", "\t", "\n", "\n \n", "\x1f", "　", "//c", "# d", "/* e\n*/", '"""f\n"""', "'''g'''", "KelvinK", "BREAK", "9IN"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "\n\n\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", text.standardize_whitespace(F.col("s")), text.preprocess(F.col("s"), batch=True), text.normalize_case(F.col("s"))).collect()
    for s, spaced, whole, cased in rows:
        assert (text.spaced(s), text.cased(text.spaced(text.without_comments(s))), text.cased(s)) == (spaced, whole, cased)


def test_runs_of_tokens_are_dealt_before_they_are_counted(spark):
    """No table of a task's own runs: all steps of counting come after the exchange."""
    steps = [line for line in catalogue.QUERIES["token_shingles"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n") if "HashAggregate" in line or "Exchange" in line]
    assert "Exchange" in steps[-1] and all("HashAggregate" in line for line in steps[:-1])
    rows = catalogue.QUERIES["preprocessed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in rows and "BatchEvalPython" in rows


@pytest.mark.parametrize("name", ["line_jaccard_pairs", "signature_match"])
def test_line_sets_are_made_once(spark, name):
    """What is joined are digests from files, never the documents' texts."""
    assert not any("documents" in f for f in catalogue.QUERIES[name](spark, SF).inputFiles())
