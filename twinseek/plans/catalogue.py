"""Queries over the driver's tables that exercise the operators, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.functions import hashing, lines, text
from twinseek.operators import evaluate, match, vectors
from twinseek.plans import code_queries

LINES = "list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(translate(trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), chr(13) || chr(9) || ' ', ''))), lambda x: length(x) >= 15))"
WORDS = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_lines(body: Column) -> Column:
    """Distinct normalised lines of prose, in which braces and quotes mean nothing."""
    stripped = F.transform(F.split(body, "\n"), lambda x: text.normalize(F.btrim(x, F.lit("\t\n\x0b\x0c\r "))))
    return F.array_distinct(F.filter(stripped, lambda x: F.length(x) >= lines.LEAST))


def line_digests(spark, sf) -> DataFrame:
    """(doc_id, lines): line sets as digests, made once."""
    return match.kept(table(spark, sf, "documents").select("doc_id", match.digests(plain_lines(F.col("text"))).alias("lines")), "line-sets")


def exact_hash_clones(spark, sf):
    """Documents whose text another one has too, by class."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"))
    groups = docs.groupBy("hash").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1")
    return docs.join(groups, "hash").select("doc_id", "class_id", "n")


def hash_join_multiplicity(spark, sf):
    """Even documents are known, odd ones targets; a row for each known copy, with the last one."""
    docs = table(spark, sf, "documents").select("doc_id", hashing.body_hash(F.lower("text")).alias("hash"))
    known = docs.filter("doc_id % 2 = 0").select("hash", F.col("doc_id").alias("known_id"))
    found = match.hash_join(known, docs.filter("doc_id % 2 = 1"), "known_id")
    return found.select("doc_id", F.col("known.known_id").alias("known_id"))


def html_comment_strip(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.length("html").alias("n_before"), F.length(F.regexp_replace("html", "(?s)<!--.*?-->", "")).alias("n_after"))


def first_line_key(spark, sf):
    """Of documents with one first line the first."""
    docs = table(spark, sf, "documents").select(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"\A[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\z", "").alias("key"), "doc_id")
    return docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def keyword_case(spark, sf):
    """P3."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_case(F.col("text"))).alias("hash"))


def line_set_classes(spark, sf):
    """The class of documents whose line sets are equal, and its size."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), plain_lines(F.col("text")).alias("lines")).filter("size(lines) > 0")
    return match.line_classes(docs).select(F.col("id").alias("doc_id"), "class_id", F.size("lines").cast("long").alias("n_lines"))


def line_jaccard_pairs(spark, sf):
    """Pairs of classes of equal line sets whose Jaccard is at least 0.5; members are in line_set_classes."""
    docs = line_digests(spark, sf).select(F.col("doc_id").alias("id"), "lines").filter("size(lines) > 0")
    classes = match.line_classes(docs).filter("id = class_id").select("id", "lines")
    return match.jaccard_pairs(classes, 0.5).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("jaccard", 6).alias("jaccard"))


def _pairs(docs: DataFrame) -> DataFrame:
    """Documents d with d + 1 as the fix, by line sets."""
    fixes = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lines").alias("fixed"))
    return docs.join(fixes, "doc_id")


def essential_lines(spark, sf):
    """E1, E2 without an oldest version, A6."""
    none = F.array().cast("array<string>")
    pairs = _pairs(line_digests(spark, sf))
    ev, ep = lines.essential_vulnerable(none, F.col("lines"), F.col("fixed")), lines.essential_patch(none, F.col("lines"), F.col("fixed"))
    return pairs.select("doc_id", F.size(ev).cast("long").alias("n_ev"), F.size(ep).cast("long").alias("n_ep"))


def signature_match(spark, sf):
    """Documents 0, 50, ... are flaws, the next ones their fixes, all documents are targets."""
    docs = line_digests(spark, sf)
    sig = _pairs(docs).filter("doc_id % 50 = 0 and size(lines) > 0")
    sv = F.array_except("lines", "fixed")
    sig = sig.select(F.col("doc_id").alias("sig_id"), sv.alias("sv"), F.array_except(F.array_except("fixed", "lines"), sv).alias("sp"), F.col("lines").alias("ref"))
    targets = docs.select(F.col("doc_id").alias("target_id"), "lines").filter("size(lines) > 0")
    return match.signature_match(sig, targets).select("sig_id", "target_id", F.round("score", 6).alias("score"))


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def cosine_topk(spark, sf):
    """The nearest other vector, for every id divisible by 50."""
    v = _vectors(spark, sf)
    found = vectors.similar(v.filter("id % 50 = 0"), v, k=1)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


def cosine_threshold(spark, sf):
    """F1: how many other vectors are at least 0.3 alike, for every id divisible by 50 that has any."""
    v = _vectors(spark, sf)
    return vectors.similar(v.filter("id % 50 = 0"), v, threshold=0.3).groupBy("query_id").agg(F.count("*").alias("n"))


def nearer_to_vuln_than_fix(spark, sf):
    """Vectors 0, 50, ... are flaws, the next ones their fixes; all others are clones at 0.1 and more, if the flaw is nearer."""
    v = _vectors(spark, sf)
    fixes = v.select((F.col("id") - 1).alias("id"), F.col("v").alias("beside"))
    near = vectors.similar(v.filter("id % 50 = 0").join(fixes, "id"), v, threshold=0.1, beside=True)
    kept = match.fix_filter(near.withColumnsRenamed({"similarity": "s_vuln", "beside": "s_fix"}).withColumn("fix_id", F.col("query_id") + 1))
    return kept.select(F.col("query_id").alias("vuln_id"), F.col("id").alias("clone_id"), F.round("s_vuln", 6).alias("s_vuln"), F.round("s_fix", 6).alias("s_fix"))


def pair_first_fix(spark, sf):
    """Every user turn with the first answer of its conversation."""
    turns = table(spark, sf, "conversations")
    fixes = match.first_wins(turns.filter("role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("fix_hash")), ["conv_id"], "turn").select("conv_id", F.col("turn").alias("fix_turn"), "fix_hash")
    return turns.filter("role = 'user'").select("conv_id", "turn").join(fixes, "conv_id")


def lookup_last_wins(spark, sf):
    """J5, A16."""
    events = table(spark, sf, "events")
    last = match.last_wins(events.select("user_id", "event_id", "props"), ["user_id"], "event_id")
    return last.select("user_id", "event_id", "props")


def fallback_first_line(spark, sf):
    """Benchmark items as flaws, documents as fixes."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("vuln_id"), F.col("text").alias("body"))
    fixes = table(spark, sf, "documents").select(F.col("doc_id").alias("fix_id"), F.col("text").alias("body"))
    return match.with_fix(items, fixes).select("vuln_id", "fix_id", "how")


def confusion_matrix_hash(spark, sf):
    """Groups are languages, originals have quality 1."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    entries = docs.select(F.col("lang").alias("group"), hashing.body_hash(F.lower("text")).alias("hash"), (F.col("quality") == 1).alias("original"), (F.col("quality") == 1).alias("clone"))
    found = evaluate.with_ratios(evaluate.pair_counts(entries))
    return found.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def verdict_summary(spark, sf):
    """An odd k is a flaw, its last digit the confidence."""
    rows = table(spark, sf, "events").select(F.from_json("props", "k int").alias("p")).select(F.when(F.col("p.k").isNull(), "none").alias("error"), (F.col("p.k") % 2 == 1).alias("is_vulnerable"), (F.col("p.k") % 10).alias("confidence_level"))
    return evaluate.verdicts(rows)


def activity_filter(spark, sf):
    """Customers with an order since 1998 of whose orders a tenth are done."""
    found = match.active("o_custkey", table(spark, sf, "orders"), "o_orderdate", F.col("o_orderstatus") == "F", F.lit("1998-01-01").cast("timestamp"))
    return found.select("o_custkey", F.round("rate", 6).alias("rate"))


def group_counts_desc(spark, sf):
    """A8, A9, W3."""
    return evaluate.counts_by(table(spark, sf, "documents"), "lang")


def token_shingles(spark, sf):
    """Distinct runs of three tokens and how often they stand. Nearly all are distinct, so they are dealt before they are
    counted: tables of a task's own runs would spill and save nothing."""
    docs = table(spark, sf, "documents").select(F.explode(hashing.shingles(hashing.word_tokens(F.col("text")))).alias("shingle"))
    return docs.repartition("shingle").groupBy("shingle").agg(F.count("*").alias("n"))


def indexed_rename_hash(spark, sf):
    """B4, M9."""
    return table(spark, sf, "documents").select("doc_id", hashing.renamed_hash(F.col("text")).alias("hash"))


def simhash64(spark, sf):
    """A18, M6, K12."""
    return hashing.simhash(table(spark, sf, "documents"), "doc_id", hashing.shingles(hashing.word_tokens(F.col("text"))))


def resume_anti(spark, sf):
    """Documents whose first line is no benchmark item's."""
    docs = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("key"))
    done = table(spark, sf, "benchmark").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("key"))
    return match.unprocessed(docs, done, "key").select("doc_id")


def nested_json_roundtrip(spark, sf):
    """To one JSON document for each source, and back."""
    from twinseek.sources.sinks import nested

    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("source").alias("repo"), F.col("lang").alias("vuln_text"), F.col("doc_id").cast("string").alias("clone_text"), (F.col("n_chars") / 7).alias("similarity"), F.concat_ws("/", "source", "doc_id").alias("path"), F.lit("u").alias("commit_url"))
    leaf = "struct<similarity: double, path: string, commit_url: string>"
    back = nested(rows).select("repo", F.from_json("json", f"results map<string, map<string, {leaf}>>").alias("d"))
    back = back.select("repo", F.explode("d.results").alias("lang", "m")).select("repo", "lang", F.explode("m").alias("id", "v"))
    return back.select("repo", "lang", F.col("id").cast("long").alias("doc_id"), F.round("v.similarity", 6).alias("similarity"), F.col("v.path").alias("path"))


NAMES = (
    exact_hash_clones, hash_join_multiplicity, html_comment_strip, first_line_key, keyword_case, line_set_classes, line_jaccard_pairs, essential_lines,
    signature_match, cosine_topk, cosine_threshold, nearer_to_vuln_than_fix, pair_first_fix, lookup_last_wins, fallback_first_line, confusion_matrix_hash,
    verdict_summary, activity_filter, group_counts_desc, token_shingles, indexed_rename_hash, simhash64, resume_anti, nested_json_roundtrip,
)
QUERIES = {f.__name__: f for f in NAMES} | code_queries.QUERIES

COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
FIRST = f"trim(split_part(text, chr(10), 1), {TRIM})"
HASH = r"md5(regexp_replace(lower(text), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g'))"
UNICODE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NO_NAMES = ", ".join(f"'{w}'" for w in text.CPP_KEYWORDS + text.CPP_SPECIAL)
ORACLE_SQL = {
    "exact_hash_clones": "SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY md5(text)) QUALIFY count(*) OVER w > 1",
    "hash_join_multiplicity": f"WITH d AS (SELECT doc_id, {HASH} AS h FROM documents), k AS (SELECT h, max(doc_id) OVER (PARTITION BY h) AS known_id FROM d WHERE doc_id % 2 = 0) SELECT d.doc_id, k.known_id FROM d JOIN k USING (h) WHERE d.doc_id % 2 = 1",
    "html_comment_strip": "SELECT page_id, length(html)::INT AS n_before, length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'))::INT AS n_after FROM pages",
    "first_line_key": f"SELECT {FIRST} AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "keyword_case": r"SELECT doc_id, md5(list_aggregate(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda w: CASE WHEN lower(w) IN (" + ", ".join(f"'{k}'" for k in text.CASE_KEYWORDS) + ") THEN lower(w) ELSE w END), 'string_agg', '')) AS hash FROM documents",
    "line_set_classes": f"WITH d AS (SELECT doc_id, list_sort({LINES}) AS l FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id, len(l) AS n_lines FROM d WHERE len(l) > 0",
    "line_jaccard_pairs": f"WITH d AS (SELECT doc_id, list_sort({LINES}) AS l FROM documents), c AS (SELECT min(doc_id) AS id, l, len(l) AS n FROM d WHERE len(l) > 0 GROUP BY l), e AS (SELECT id, n, unnest(l) AS x FROM c), p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL) SELECT id_a, id_b, round(k / (na + nb - k), 6) AS jaccard FROM p WHERE k / (na + nb - k) >= 0.5",
    "essential_lines": f"WITH d AS (SELECT doc_id, {LINES} AS l FROM documents) SELECT a.doc_id, len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) AS n_ev, len(list_filter(b.l, lambda x: NOT list_contains(a.l, x))) AS n_ep FROM d a JOIN d b ON b.doc_id = a.doc_id + 1",
    "signature_match": f"WITH d AS (SELECT doc_id, {LINES} AS l FROM documents), s AS (SELECT a.doc_id AS sig_id, a.l AS ref, list_filter(a.l, lambda x: NOT list_contains(b.l, x)) AS sv, list_filter(b.l, lambda x: NOT list_contains(a.l, x)) AS sp FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 50 = 0 AND len(a.l) > 0), m AS (SELECT sig_id, t.doc_id AS target_id, len(list_intersect(ref, t.l)) AS k, len(ref) + len(t.l) - len(list_intersect(ref, t.l)) AS u, list_has_all(t.l, sv) AS c1, NOT list_has_any(t.l, sp) AS c2, len(sv) AS nv, len(sp) AS np FROM s, d t WHERE len(t.l) > 0) SELECT sig_id, target_id, round(k / u, 6) AS score FROM m WHERE k / u >= 0.5 AND CASE WHEN np = 0 THEN c1 WHEN nv = 0 THEN c2 ELSE c1 AND c2 END",
    "cosine_topk": f"SELECT query_id, vec_id, round(s, 6) AS similarity FROM (SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) = 1",
    "cosine_threshold": f"SELECT a.vec_id AS query_id, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND {COSINE} >= 0.3 GROUP BY 1",
    "nearer_to_vuln_than_fix": f"WITH p AS (SELECT a.vec_id AS vuln_id, b.vec_id AS clone_id, {COSINE} AS s_vuln, b.embedding FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT vuln_id, clone_id, round(s_vuln, 6) AS s_vuln, round(s_fix, 6) AS s_fix FROM (SELECT p.*, list_cosine_similarity(f.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s_fix FROM p JOIN embeddings f ON f.vec_id = p.vuln_id + 1 WHERE s_vuln >= 0.1) WHERE s_fix < s_vuln",
    "pair_first_fix": "WITH f AS (SELECT conv_id, min(turn) AS fix_turn, md5(arg_min(text, turn)) AS fix_hash FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, turn, fix_turn, fix_hash FROM conversations JOIN f USING (conv_id) WHERE role = 'user'",
    "lookup_last_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY 1",
    "fallback_first_line": f"WITH d AS (SELECT doc_id, text, {FIRST} AS k FROM documents), e AS (SELECT text, min(doc_id) AS x FROM d GROUP BY 1), l AS (SELECT k, min(doc_id) AS y FROM d GROUP BY 1) SELECT item_id::BIGINT AS vuln_id, coalesce(x, y) AS fix_id, CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'first_line' ELSE 'none' END AS how FROM benchmark b LEFT JOIN e ON e.text = b.text LEFT JOIN l ON l.k = trim(split_part(b.text, chr(10), 1), {TRIM})",
    "confusion_matrix_hash": f"WITH e AS (SELECT doc_id, lang, {HASH} AS h, quality = 1 AS q FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (b.q AND a.h = b.h) AS tp, count(*) FILTER (NOT b.q AND a.h = b.h) AS fp, count(*) FILTER (b.q AND a.h <> b.h) AS fn, count(*) FILTER (NOT b.q AND a.h <> b.h) AS tn FROM e a JOIN e b ON a.lang = b.lang AND a.doc_id <> b.doc_id WHERE a.q), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c) SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r",
    "verdict_summary": "WITH v AS (SELECT (props ->> '$.k')::INT AS k FROM events) SELECT count(*) AS total, count(*) FILTER (k IS NULL) AS errors, count(*) FILTER (k % 2 = 1) AS vulnerable, count(*) FILTER (k % 2 = 1 AND k % 10 >= 4) AS sure FROM v",
    "activity_filter": "SELECT o_custkey, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY 1 HAVING avg((o_orderstatus = 'F')::INT) >= 0.1 AND max(o_orderdate) >= TIMESTAMP '1998-01-01'",
    "group_counts_desc": "SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang",
    "token_shingles": f"WITH t AS (SELECT {WORDS} AS w FROM documents), s AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || w[i + 1] || w[i + 2])) AS shingle FROM t WHERE len(w) >= 3) SELECT shingle, count(*) AS n FROM s GROUP BY 1",
    "indexed_rename_hash": rf"""
WITH RECURSIVE flat AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{UNICODE_SPACE}+|{UNICODE_SPACE}+$', '', 'g')), lambda x: x <> ''), chr(10)) AS t FROM documents),
parts AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), 1) AS pos FROM flat),
firsts AS (SELECT doc_id, w, min(pos) AS pos FROM parts WHERE regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND w NOT IN ({NO_NAMES}) GROUP BY ALL),
ranked AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM firsts),
chase AS (
  SELECT doc_id, w, k FROM ranked
  UNION ALL
  SELECT c.doc_id, c.w, r.k FROM chase c JOIN ranked r ON r.doc_id = c.doc_id AND r.w = 'a' || c.k AND r.k > c.k),
names AS (SELECT doc_id, w, 'a' || max(k) AS new_name FROM chase GROUP BY ALL)
SELECT d.doc_id, md5(coalesce(x.t, '')) AS hash FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(coalesce(new_name, w), '' ORDER BY pos) AS t FROM parts LEFT JOIN names USING (doc_id, w) GROUP BY 1) x USING (doc_id)""",
    "simhash64": f"WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT doc_id, ('0x' || substr(md5(unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || w[i + 1] || w[i + 2]))), 17, 16))::UBIGINT AS h FROM t WHERE len(w) >= 3), b AS (SELECT doc_id, i, sum((h >> i::UBIGINT) & 1) AS ones, count(*) AS n FROM s, range(64) r(i) GROUP BY ALL), f AS (SELECT doc_id, sum(CASE WHEN ones * 2 > n THEN 1::HUGEINT << i::INT ELSE 0 END)::UBIGINT AS x FROM b GROUP BY 1) SELECT d.doc_id, coalesce(x, 0)::VARCHAR AS simhash FROM documents d LEFT JOIN f USING (doc_id)",
    "resume_anti": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE split_part(b.text, chr(10), 1) = split_part(d.text, chr(10), 1))",
    "nested_json_roundtrip": "SELECT source AS repo, lang, doc_id, round(n_chars / 7, 6) AS similarity, source || '/' || doc_id AS path FROM documents",
}
ORACLE_SQL |= code_queries.ORACLE_SQL
