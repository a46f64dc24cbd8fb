"""Differencing of pages against brute force over all pages of a host."""

import random

import numpy as np

from twinseek.llm import pages


def lcs(a, b):
    """The length of a longest common subsequence, by the plain table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg"[: rng.randrange(1, 8)]) for _ in range(rng.randrange(12))] for _ in range(2))
        found = sorted(pages.shared(a, b))
        assert len(found) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def site(seed=0):
    """Pages without an article element, with lines that others of their host have too, copies, and repeated rows."""
    rng, rows = random.Random(seed), []
    for k in range(160):
        host = rng.choice(["a.b", "a.b", "c.d", "e.f"])
        body = [f"Template {rng.randrange(4)}" for _ in range(rng.randrange(4))] + [f"Own line {rng.randrange(60)}" for _ in range(rng.randrange(1, 5))]
        rng.shuffle(body)
        rows.append((k, f"http://{host}/{rng.choice('xy')}/{rng.choice('pqr')}{rng.randrange(40)}", "".join(f"<p>{t}</p>" for t in body) + "<footer>foot</footer>"))
    rows += [(200 + i, rows[0][1] if i % 2 else f"http://a.b/copy/{i:03d}", rows[0][2]) for i in range(60)]
    return rows + [rows[5], (300, "http://only.one/x", "<p>Alone</p>"), (301, "http://a.b/zz", "<article><p>Template 1</p></article><p>x</p>")]


def brute(rows):
    """Texts by scanning all pages of the host for the nearest ones with other lines."""
    split = [(u.split("/")[2], "/" + u.split("/", 3)[3], pages.lines(h)) for _, u, h in rows]
    hashes = pages.line_hashes([page for _, _, page in split])
    keys = [(host, path, pages.hashlib.blake2b(own.tobytes(), digest_size=16).digest()) for (host, path, _), own in zip(split, hashes)]
    out = []
    for (host, path, page), key in zip(split, keys):
        texts = [t for t, _, _ in page]
        if any(inside and not off for _, inside, off in page):
            out.append("\n\n".join(t for t, inside, off in page if inside and not off))
            continue
        before = max((k for k in keys if k < key and k[0] == host and k[2] != key[2]), default=None)
        after = min((k for k in keys if k > key and k[0] == host and k[2] != key[2]), default=None)
        near = [k for k in (before, after) if k]
        lost = set()
        if near:
            best = max(near, key=lambda k: pages.beginning(k[1], path))
            lost = pages.shared(texts, [t for t, _, _ in split[keys.index(best)][2]])
        out.append("\n\n".join(t for i, (t, _, off) in enumerate(page) if not off and i not in lost))
    return out


def test_pages_lose_what_their_nearest_neighbours_share(spark):
    rows = site()
    want = sorted(zip([r[0] for r in rows], brute(rows)))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = pages.extract(frame.repartition(parts)).collect()
            assert sorted((r["page_id"], r["text"]) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ends_and_runs():
    page = lambda path, d: pages.Page("h", path, bytes([d]), np.array([d]), np.array([False]), True)
    rows = [page(f"/{i}", d) for i, d in enumerate([1, 1, 2, 2, 2, 3])]
    first, last = pages.ends(iter(rows))
    assert [x.path for x in first] == ["/0", "/2"] and [x.path for x in last] == ["/5", "/4"]
    beside = pages.around({0: pages.ends(iter(rows[:2])), 3: pages.ends(iter(rows[2:5])), 4: pages.ends(iter(rows[5:]))})
    assert [x.path for x in beside[4][0]] == ["/4", "/1"] and [x.path for x in beside[0][1]] == ["/2", "/5"] and not beside[0][0]
