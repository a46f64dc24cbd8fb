"""Hand-made cases of the text functions, line sets, abstraction, joins, sources and sinks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from twinseek import __main__ as cli
from twinseek.functions import abstraction, hashing, lines, text
from twinseek.operators import evaluate, extract, match, vectors
from twinseek.sources import readers, sinks


def of(spark, f, *values):
    """What a column function gives for each string."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["r"] for r in rows.select("i", f(F.col("s")).alias("r")).orderBy("i").collect()]


LONG = '"' + "x" * 20000 + '"'
CASES = [
    (text.remove_comments, 's = "http://x";', 's = "http:'), (text.remove_comments, "#define A", ""), (text.remove_comments, "/* a // b */ c", "/* a "),
    (text.strip_comments, '"a//b" // c', '"a//b" '), (text.strip_comments, LONG, LONG), (text.strip_comments, "x; /* open", "x; /* open"),
    (text.standardize_whitespace, "a\n\t b\n\n\n\n  c  \n", "a\n    b\n\nc"), (text.normalize_case, "IF INTx éif", "if INTx éif"),
    (text.numeric_type, "1", True), (text.numeric_type, "2.0", False), (text.numeric_type, "fix", False), (text.numeric_type, None, False),
    (text.clean_json, 'x === JSON RESPONSE ===\n{"a": True}\n=== END JSON === y', '{"a": true}'), (text.clean_json, '```json\n{"a": 1}\n```', '{"a": 1}'), (text.clean_json, "none here", ""),
    (text.language_of, "a/b.CC", "cpp"), (text.language_of, "a/b", "c"), (text.first_line, " a \nb", "a"), (text.preprocess, "", ""), (text.preprocess, None, None),
    (lines.line_set, "123456789012345\n12345678901234", ["123456789012345"]), (lines.line_set, "} else if (xxxxxxxxxx) {", ["elseif(xxxxxxxxxx){"]),
    (lines.line_list, "void f() {\n} else if (xxxxxxxxxx) {", ["}elseif(xxxxxxxxxx){"]),
    (lines.long_enough, "a\nb\nc", False), (lines.long_enough, "a\nb\nc\nd", True), (lines.long_enough, "a\n\nb\n\nc", False),
    (abstraction.indexed_rename, "x a1", "a2 a2"), (abstraction.rename_tokens, "x = a1 + 'x';", "a1 = a2 + 'x';"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_text(spark, k):
    f, given, want = CASES[k]
    assert of(spark, f, given) == [want]


def test_names_are_replaced_in_turn(spark):
    assert of(spark, lambda s: abstraction.replace_in_turn(s, F.array(F.lit("a")), "P"), "a,a+b") == ["P,a+b"]


def test_shingles(spark):
    assert [len(x) for x in of(spark, lambda s: hashing.shingles(hashing.word_tokens(s)), "", "a b", "a b c", "a b c d")] == [0, 0, 1, 2]


def test_jaccard(spark):
    rows = spark.createDataFrame([([], []), ([], ["x"]), (["x"], ["x"]), (["x", "y"], ["y", "z"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(lines.jaccard(F.col("a"), F.col("b"))).collect()] == [1, 0, 1, 1 / 3]


def test_jaccard_pairs_are_those_of_brute_force(spark):
    sets = {i: {f"line {(i * j) % (7 + i % 3)}" for j in range(1, 3 + i % 5)} for i in range(40)}
    got = match.jaccard_pairs(spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, lines array<string>"), 0.5).collect()
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.5}
    assert {(r["a"], r["b"]): r["jaccard"] for r in got} == pytest.approx(want)


def test_top_k_with_ties_and_few_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    found = lambda k: sorted((r["query_id"], r["rank"], r["id"]) for r in vectors.similar(v.filter("id = 3"), v, k=k).collect())
    assert found(1) == [(3, 1, 1)] and found(9) == [(3, 1, 1), (3, 2, 2)]


def test_known_hashes_multiply(spark):
    known = spark.createDataFrame([("h", 1), ("h", 2), ("g", 3)], "hash string, k int")
    got = match.hash_join(known, spark.createDataFrame([("h", 7), ("x", 8)], "hash string, t int"), "k").collect()
    assert [(r["t"], r["known"]["k"]) for r in got] == [(7, 2), (7, 2)]


def test_signature_modes(spark):
    rows = [("no patch", ["a"], []), ("none", [], []), ("patched", [], ["c"]), ("unpatched", [], ["z"]), ("missing", ["q"], []), ("both", ["a"], ["z"])]
    signs = spark.createDataFrame([(n, v, p, ["a", "b", "c"]) for n, v, p in rows], "sig_id string, sv array<string>, sp array<string>, ref array<string>")
    targets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "y"]), (3, ["a", "b", "c", "d", "e", "f", "g"])], "target_id int, lines array<string>")
    got = {(r["sig_id"], r["target_id"], r["score"]) for r in match.signature_match(signs, targets).collect()}
    assert got == {(n, 1, 1.0) for n in ("no patch", "none", "unpatched", "both")}


def test_ratios_without_detections(spark):
    zero = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 3, 1)], "tp long, fp long, fn long, tn long")
    assert [tuple(r)[4:] for r in evaluate.with_ratios(zero).collect()] == [(1.0, 0.0, 0.0)] * 2


def test_encodings_and_functions():
    assert extract.decode("한".encode()) == extract.decode("한".encode("cp949")) == "한" and extract.decode(b"\xff\xff\xff") is None
    code = "int f(int a) {\n  if (a) { return 1; }\n  return 0;\n}\nstruct s { int x; };"
    assert extract.functions_of(code) == [code[: code.index("\nstruct")]]


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert [(r["line_number"], r["a"]) for r in readers.numbered_lines(spark, str(tmp_path), "a int").collect()] == [(1, 1), (4, 2)]


def test_bodies_by_precedence(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"func": "c", "vuln_func": "b"}\nbad\n{"function": "a", "func": "c"}\n')
    assert sorted(r["body"] for r in readers.corpus(spark, str(tmp_path), tolerant=True).collect()) == ["a", "b"]


def test_nested_documents_return(spark, tmp_path):
    rows = spark.createDataFrame([("r", "v", "c", 0.5, "p", None), ("r", "v", "d", 1.0, "q", "u")], "repo string, vuln_text string, clone_text string, similarity double, path string, commit_url string")
    (tmp_path / "r.json").write_text(sinks.nested(rows).first()["json"])
    back = readers.nested_results(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r) for r in rows.select(back.columns).collect())


def test_updates(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = sinks.updated(table, spark.createDataFrame([(2, None)], "k int, v string"), "k").collect()
    assert {r["k"]: r["v"] for r in got} == {1: "a", 2: None}


def test_signatures_are_made_and_found(spark, tmp_path):
    flaw = "int f(char *p) {\n  strcpy(buffer, pointer);\n  return length_of(buffer);\n}"
    fixed = flaw.replace("strcpy(buffer, pointer)", "strncpy(buffer, pointer, 8)")
    rows = [{"commit_id": "c1", "target": 1, "func": flaw}, {"commit_id": "c1", "target": 0, "func": fixed}, {"commit_id": "c2", "target": 1, "func": flaw}]
    (tmp_path / "pairs.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "repo_functions.json").write_text(json.dumps([{"path": "a.c", "function": flaw}, {"path": "b.c", "function": fixed}, {"path": "c.c", "function": " "}]))
    cli.main(["signatures", str(tmp_path / "pairs.jsonl"), str(tmp_path / "signed")])
    cli.main(["detect", str(tmp_path / "signed"), str(tmp_path / "in"), str(tmp_path / "found")])
    got = spark.read.json(str(tmp_path / "found")).collect()
    assert [(r["sig_id"], r["repo"], r["path"], r["score"]) for r in got] == [("c1#1", "repo", "a.c", 1.0)]


def test_line_numbers_go_on_over_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"a": i, "pad": "x" * (i % 90)}) + "\n" if i % 7 else "\n" for i in range(1, 3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path), "a int")
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 2 * len([i for i in range(1, 3000) if i % 7]) and all(r["line_number"] == r["a"] for r in got)


FLAW = "int copy(char *text) {\n  char *place = make_room(text);\n  strcpy(place, text);\n  return finish(place);\n}"
FIXED = FLAW.replace("strcpy(place, text)", "if (text == NULL) { return -1; }\n  strlcpy(place, text, 16)")


def test_retrieval_finds_clones_and_spares_fixes(spark, tmp_path):
    rows = [{"function": FLAW, "fix_func": FIXED, "commit_url": "http://u/1"}, {"func": "void other(int z) {\n  while (z) { z--; }\n}"}]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r_functions.json").write_text(json.dumps([{"path": "a.c", "function": FLAW}, {"path": "b.c", "function": FLAW + " // same"}, {"path": "c.c", "function": FIXED}, {"path": "", "function": "x y z"}]))
    ask = ["retrieve", str(tmp_path / "corpus.jsonl"), str(tmp_path / "in"), str(tmp_path / "out"), "--work", str(tmp_path / "work"), "--no_abstraction"]
    cli.main(ask)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["repo"], r["path"], r["commit_url"], round(r["similarity"], 6), r["fix_match"]) for r in got] == [("r", "b.c", "http://u/1", 1.0, "exact")]
    vectors_known = spark.read.parquet(str(tmp_path / "work" / "vectors")).count()
    cli.main([*ask, "--disable_filtering"])  # done already
    assert [r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b.c"]
    cli.main([*ask, "--disable_filtering", "--again"])
    assert sorted(r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["b.c", "c.c"]
    assert spark.read.parquet(str(tmp_path / "work" / "vectors")).count() == vectors_known


def test_exact_copies_evaluation_and_verdicts(spark, tmp_path):
    from twinseek.plans import retrieval

    (tmp_path / "known.jsonl").write_text("\n".join(json.dumps({"func": FLAW, "cve": c}) for c in ("first", "last")))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r_functions.json").write_text(json.dumps([{"path": "a.c", "function": FLAW.replace("  ", "\t")}, {"path": "b.c", "function": FIXED}]))
    cli.main(["exact", str(tmp_path / "known.jsonl"), str(tmp_path / "in"), str(tmp_path / "out")])
    assert [(r["path"], r["known"]["cve"]) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("a.c", "last")] * 2
    entries = [(1, FLAW, "original"), (1, FLAW.replace("place", "spot"), "1"), (1, "int x;", "2"), (1, FIXED, "fix"), (2, FLAW, "original"), (2, FLAW, "note")]
    (tmp_path / "entries.jsonl").write_text("\n".join(json.dumps({"label": a, "code": b, "type": c}) for a, b, c in entries))
    assert tuple(retrieval.evaluated(spark, str(tmp_path / "entries.jsonl")).select("tp", "fp", "fn", "tn").first()) == (1, 0, 1, 1)
    results = spark.createDataFrame([("v", "c1"), ("v", "c2"), ("w", "c3")], "vuln_text string, clone_text string")
    sources = spark.createDataFrame([("v", "f")], "body string, fix_func string")
    got = retrieval.judged(results, sources, lambda _: '{"is_vulnerable": true, "confidence_level": 4, "justification": "j"}', limit=1).collect()
    assert [(r["clone_text"], r["is_vulnerable"], r["confidence_level"], r["error"]) for r in got] == [("c1", True, 4, None)]


RENAMED = """int copy(char *text, int size) {
  int place = room_for(size, text_of(text));
  strcpy(place_of(place), text_of(text));
  return finish_with(place, size);
}"""


def test_a_copy_with_other_names_is_found(spark):
    from twinseek.plans import detection

    fixed = RENAMED.replace("strcpy(place_of(place), ", "strlcpy(limit_of(size), place_of(place), ")
    other = re.sub(r"\bplace\b", "spot", RENAMED.replace("size", "amount"))
    pairs = spark.createDataFrame([("s", RENAMED, RENAMED, fixed)], "sig_id string, fo string, fd string, fp string")
    signed = detection.signatures(pairs)
    targets = detection.targets_of(spark.createDataFrame([(1, RENAMED), (2, other), (3, fixed), (4, fixed.replace("size", "amount")), (5, "int x;")], "target_id int, function string"))
    assert {(r["target_id"], r["score"]) for r in detection.detect(signed, targets).collect()} == {(1, 1.0), (2, 1.0)}
    assert tuple(detection.conditions(signed, targets).first()) == (2, 2, 4, 2)
    assert {r["target_id"] for r in detection.detect(signed, targets, 0.0).collect()} == {1, 2}


def test_graphs_give_dependent_lines(spark):
    from twinseek.plans import detection

    flaw = "int f(int size) {\n  int total = size_of(buffer);\n  if (total > limit_of(buffer)) {\n  copy_all(buffer, total);\n}"
    fixed = flaw.replace("copy_all(buffer, total)", "copy_some(buffer, total)")
    edges = ["noise", "EDGES_START", "REACHING_DEF:1:int total = size_of(buffer);:LOCAL:3:copy_all(buffer, total):CALL", "CFG:2:if (total > limit_of(buffer)) {:CONTROL_STRUCTURE:3:__x:CALL", "AST:2:<global>:X:3:RET:Y", "EDGES_END", "CFG:9:unseen_code_here():A:9:copy_all(buffer, total):B"]
    graphs = spark.createDataFrame([("s", "fd", i, line) for i, line in enumerate(edges)], "sig_id string, side string, pos long, line string")
    pairs = spark.createDataFrame([("s", flaw, flaw, fixed), ("t", flaw, flaw, fixed)], "sig_id string, fo string, fd string, fp string")
    got = {r["sig_id"]: r for r in detection.signatures(detection.with_graphs(pairs, graphs)).collect()}
    norm = lambda r, c: [x["norm"] for x in r[c]]
    assert norm(got["s"], "ev") == norm(got["t"], "ev") == ["copy_all(buffer,total);"]
    assert norm(got["s"], "dv") == ["inttotal=size_of(buffer);"] and norm(got["s"], "fv") == ["if(total>limit_of(buffer)){"]
    assert norm(got["t"], "dv") == norm(got["t"], "fv") == [] and (got["s"]["n_dp"], got["s"]["processing_status"]) == (0, "success")


def test_signature_match_is_that_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    names = [f"line {i}" for i in range(12)]
    some = lambda n: rng.sample(names, rng.randrange(n))
    signs = []
    for i in range(60):
        sv = some(4)
        signs.append((i, sv, [x for x in some(4) if x not in sv], some(9)))
    targets = [(i, some(10)) for i in range(80)]
    signed = spark.createDataFrame(signs, "sig_id int, sv array<string>, sp array<string>, ref array<string>")
    there = spark.createDataFrame(targets, "target_id int, lines array<string>")
    for theta in (0.3, 0.5, 1.0, 0.0):
        want = set()
        for s, sv, sp, ref in signs:
            for t, own in targets:
                score = len(set(ref) & set(own)) / len(set(ref) | set(own)) if ref else 0.0
                first, second = set(sv) <= set(own), not set(sp) & set(own)
                if score >= theta and (first if not sp else second if not sv else first and second):
                    want.add((s, t, round(score, 6)))
        assert {(r["sig_id"], r["target_id"], round(r["score"], 6)) for r in match.signature_match(signed, there, theta).collect()} == want


def test_vectors_of_any_length_and_content(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [None, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [2.0, 0.0]), (9, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    found = lambda: sorted((r["query_id"], r["id"], round(r["similarity"], 4)) for r in vectors.similar(table, table, threshold=0.5).collect())
    want = [(1, 2, 0.9939), (1, 8, 1.0), (2, 1, 0.9939), (2, 8, 0.9939), (8, 1, 1.0), (8, 2, 0.9939)]
    assert found() == want
    monkeypatch.setattr(vectors, "SENT", 0)
    assert found() == want


def test_repositories(spark, tmp_path):
    from twinseek.sources import repositories

    waits = []
    answers = iter([(500, {}, None), (502, {}, None), (403, {}, None), (200, {}, {"a": 1})])
    assert repositories.fetch(lambda _: next(answers), "u", sleep=waits.append) == {"a": 1} and waits[:2] == [2, 4] and 60 <= waits[2] <= 61
    assert repositories.fetch(lambda _: (500, {}, None), "u", sleep=lambda _: None) is None and repositories.fetch(lambda _: (404, {}, None), "u") is None

    def get(url):
        if "/busy/" in url:
            return 200, {}, [{"merged_at": "x"}, {"merged_at": None}]
        return 200, {}, [] if "pulls" in url else [{}]

    def clone(url, path):
        if "bad" in url:
            raise OSError("no")

    repos = [{"name": n, "url": f"http://{n}", "stars": s, "owner": "o"} for n, s in (("busy", 9), ("idle", 8), ("bad", 7))]
    get_busy = lambda url: get(url.replace("/bad/", "/busy/"))
    told = repositories.acquire(spark, "c", lambda language, below: repos if below is None else [], get_busy, "2020-01-01", str(tmp_path), clone=clone).collect()
    assert sorted((r["name"], r["status"]) for r in told) == [("bad", "failed: no"), ("busy", "cloned")]
    assert spark.read.json(str(tmp_path / "c_metadata")).count() == 3 and spark.read.json(str(tmp_path / "c_active_metadata")).count() == 2


def test_code_of_clones(spark):
    rows = [("a", "x"), ("b", "y"), ("none", "z"), (None, "w"), ("none", ""), (None, "")]
    results = spark.createDataFrame(rows, "path string, clone_text string")
    files = spark.createDataFrame([("a", b"ab\xffc"), ("b", b" \n")], "path string, content binary")
    got = sorted(r["code"] for r in readers.with_clone_code(results, files).collect())
    assert got == sorted(["abc", "y", "z", "w", "// File not found: none", "// No clone code available"])


def test_outputs_are_kept_by_repository(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "repo string, x int")
    out = str(tmp_path / "out")
    assert sinks.written(spark, out) is None
    sinks.write_new(rows(("a", 1)), out)
    sinks.write_new(rows(("a", 2), ("b", 3)), out)
    assert sorted((r["repo"], r["x"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3)]


def validate_client(prompt):
    if "boom" in prompt:
        raise ValueError("boom")
    return '{"is_vulnerable": true, "confidence_level": 5, "justification": "j"}'


def test_validate_job(spark, tmp_path):
    spark.createDataFrame([("r", "v", "c1"), ("r", "v", "boom")], "repo string, vuln_text string, clone_text string").write.parquet(str(tmp_path / "results"))
    (tmp_path / "sources.jsonl").write_text(json.dumps({"func": "v", "fix_func": "f"}))
    cli.main(["validate", "--results", str(tmp_path / "results"), "--sources", str(tmp_path / "sources.jsonl"), "--output", str(tmp_path / "out"), "--client", "tests.test_functions:validate_client", "--delay", "0", "--responses-dir", str(tmp_path / "told")])
    assert sorted((r["clone_text"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("boom", "boom"), ("c1", None)]
    assert [spark.read.json(str(tmp_path / "told" / k)).count() for k in ("raw", "parsed", "errors")] == [1, 1, 1]
