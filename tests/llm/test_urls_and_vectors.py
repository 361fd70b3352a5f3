"""URL rules and nearest neighbours against plain Python versions, and the awkward rows."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import neighbours, url_rules

URLS = [
    ("http://a.example.org/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12?x=1", "example.org/en/1", "block"),
    ("http://EXAMPLE.ORG/en/2", "org/", "allow"),
    ("http://example.org", None, "allow"),
    ("http://notexample.org/es/", "org/", "allow"),
    ("http://a.com/fr/x#y", "com/fr/", "allow"),
    ("http://a.com/de/x", "com/de/", "block"),
    ("http://acom/de/x", None, "allow"),
    ("http://com/de/", "com/de/", "block"),
    ("http://a.com?u=http://b.org/", None, "allow"),
    ("nothing", None, "allow"),
    ("", None, "allow"),
    (None, None, "allow"),
    ("x://y://z.org/es/", None, "allow"),
    ("http://É.org/es/\n", "org/", "allow"),
    ("://a.org/", "org/", "allow"),
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
    host, rest = rest[: ends[0]], rest[ends[0] :]
    ends = [i for i, c in enumerate(rest) if c in "?#"] + [len(rest)]
    return "".join(c.lower() if c.isascii() else c for c in host), rest[: ends[0]]


def pages_frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, verdict string")


def no_labels(spark):
    return spark.createDataFrame([], "url string, bad boolean")


def test_fixed_rules(spark):
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages_frame(spark, [u for u, *_ in URLS]), no_labels(spark)).collect()}
    assert len(got) == len(URLS)
    for i, (url, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"]) == plain_parts(url), url
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, verdict), url


def labelled_urls():
    out = []
    for i in range(400):
        host = f"{'bad' if i % 4 == 0 else 'good'}.site{i % 5}.net"
        path = ["shop", "news", "cheap/pills"][i % 3]
        out.append((f"http://{host}/{path}/{i}", (i % 4 == 0 and i % 3 == 2) or i % 41 == 0))
    return out


def test_mined_rules_by_enumeration(spark):
    rows = labelled_urls()
    df = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = df.select(url_rules.url_tokens(F.col("url")).alias("tokens"), "bad")
    baskets = [(frozenset(r["tokens"]), r["bad"]) for r in tokens.collect()]
    share = {True: np.mean([b for _, b in baskets]), False: 1 - np.mean([b for _, b in baskets])}
    count, with_label = Counter(), Counter()
    for items, bad in baskets:
        for k in range(1, len(items) + 1):
            for part in combinations(sorted(items), k):
                count[part] += 1
                with_label[part, bad] += 1
    need = max(0.08 * len(baskets), url_rules.MIN_ROWS)
    found = {
        (part, "block" if bad else "allow"): n / count[part]
        for (part, bad), n in with_label.items()
        if n >= need and n / count[part] >= 0.6 and n / count[part] / share[bad] > 1
    }
    want = {
        k: c
        for k, c in found.items()
        if not any(v == k[1] and set(p) < set(k[0]) and d >= c for (p, v), d in found.items())
    }
    mined = url_rules.mine_rules(tokens, 0.08, 0.6).collect()
    assert {(tuple(r["tokens"]), r["verdict"]): pytest.approx(r["confidence"]) for r in mined} == want and want
    assert any(v == "block" for _, v in want)
    singles = Counter(t for items, _ in baskets for t in items)
    assert all(singles[r["rarest"]] == min(singles[t] for t in r["tokens"]) for r in mined)


def test_mined_verdicts(spark):
    df = spark.createDataFrame(labelled_urls(), "url string, bad boolean")
    urls = ["http://bad.site2.net/cheap/pills/9999", "http://good.site1.net/news/5", "http://other.net/", None] * 3
    got = url_rules.judge_urls(pages_frame(spark, urls), df, min_support=0.05, min_confidence=0.6).collect()
    verdicts = {(r["page_id"] % 4, r["verdict"], r["rule"]) for r in got}
    assert verdicts == {(0, "block", None), (1, "allow", None), (2, "allow", None), (3, "allow", None)}
    assert all(r["mined"] for r in got if r["page_id"] % 4 == 0)


@pytest.mark.parametrize("n", [200, 20_000])
def test_one_support_at_every_size(spark, n):
    rows = [(f"http://{'trap' if i % 50 == 0 else 'fine'}.net/p/{i}", i % 50 == 0) for i in range(n)]
    pages = pages_frame(spark, ["http://trap.net/p/x", "http://fine.net/p/x", "http://com/de/", "http://trap.net/a path:p", None])
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "block", 4: "allow"}


def test_few_mixed_rows_make_no_rule(spark):
    rows = [("http://a.net/x", True)] * 3 + [("http://b.net/x", i < 6) for i in range(10)] + [("http://c.net/y", False)] * 30
    tokens = spark.createDataFrame(rows, "url string, bad boolean").select(url_rules.url_tokens(F.col("url")).alias("tokens"), "bad")
    blocked = [r["tokens"] for r in url_rules.mine_rules(tokens).where("verdict = 'block'").collect()]
    assert not any("host:a" in t or "host:b" in t for t in blocked)  # 3 of 3 and 6 of 10 are no evidence


def test_no_pages(spark):
    assert url_rules.judge_urls(pages_frame(spark, ["x"]).limit(0), no_labels(spark)).count() == 0


# ---------------------------------------------------------------- vectors


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double")


def vector_rows(n=900, size=16):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, size))
    rows = [(i, (centres[i % 6] + 0.6 * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]
    hot = rows[50][1]
    rows += [(i, hot) for i in range(2000, 2300)]
    rows += [(3000, None), (3050, [0.0] * size), (3100, [float("nan")] + [1.0] * (size - 1)), (3150, [None] + [1.0] * (size - 1))]
    return rows + [(3200, [float("inf")] * size), (3250, [1.0, 2.0]), (3300, []), (None, hot)]


def exact_nearest(rows, k=5):
    size = 16
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) == size and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    unit = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(unit @ unit[q], 12)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_ties(spark):
    rows = vector_rows()
    want = exact_nearest(rows)
    got = {}
    for r in neighbours.nearest(vectors_frame(spark, rows), F.col("vec_id") % 50 == 0, cell_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(want)
    hits = sum(len({i for i, *_ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, answer in got.items():
        assert [k for *_, k in answer] == [1, 2, 3, 4, 5] and all(i != q for i, *_ in answer)
        assert all(a[1] >= b[1] - 1e-12 for a, b in zip(answer, answer[1:]))
    assert [i for i, *_ in got[50]] == [2000, 2001, 2002, 2003, 2004]
    assert [i for i, *_ in got[2000]] == [50, 2001, 2002, 2003, 2004]
    assert got[2050][0][1] == pytest.approx(1)


def test_one_cell_and_many_give_scores_of_the_original_vectors(spark):
    rows = vector_rows(200)
    by = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and len(v) == 16 and None not in v}
    for r in neighbours.nearest(vectors_frame(spark, rows), F.col("vec_id") % 50 == 0).collect():
        a, b = by[r["query_id"]], by[r["vec_id"]]
        assert r["score"] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_each_length_is_searched(spark):
    rows = vector_rows(200) + [(i, v[:4]) for i, v in vector_rows(150) if i is not None and i < 150]
    rows = [(i if len(v or []) != 4 else 10_000 + i, v) for i, v in rows]
    df = vectors_frame(spark, rows)
    whole = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    parts = {}
    for size in (4, 16):
        part = neighbours.nearest(df.where(F.size("embedding") == size), F.col("vec_id") % 50 == 0).collect()
        parts |= {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in part}
    assert whole == parts
    assert {q for q, _ in whole if 10_000 <= q} == {10_000, 10_050, 10_100}
    assert all(q >= 10_000 and v >= 10_000 or q < 10_000 and v < 10_000 for (q, _), (v, _) in whole.items())


def test_few_and_no_vectors(spark):
    few = neighbours.nearest(vectors_frame(spark, [(50, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert neighbours.nearest(vectors_frame(spark, []), F.lit(True)).count() == 0
    assert neighbours.nearest(vectors_frame(spark, [(1, [1.0, 2.0])]), F.col("vec_id") == 7).count() == 0


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    assert neighbours.chi_square_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-3)
