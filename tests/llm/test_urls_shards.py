"""URL filters and sharding against plain Python."""

import random
import struct
import zlib

import xxhash

from twinline.llm import shard, url_filter
from twinline.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://x.ORG/es/1", "https://example.org/es/1?q#f", "https://a.example.org/en/12",
    "https://a.example.org/en/2", "http://badexample.org/es/", "http://m.shop.com/de/", "http://com/fr/x", "http://x.org",
    "http://x.org?/es/", "http://x.net/a", "a://b://c.org/es/", "http://EXAMPLE.org/es/", "http://x.org/" + "a" * 100_000,
    "http://user@x.org:80/", "http://.org/", "http://x.org./a",
]


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_match_python(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, rules).collect()
    assert len(got) == 2 * len(URLS)
    for row in got:
        assert (row.host, row.path, row.rule, row.verdict) == judged(URLS[row.page_id % len(URLS)], URL_RULES)


def test_nested_rules_and_small_ranges(spark):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "ab", "c-d"])
    path = lambda: "/" + "".join(rng.choice(["x", "xy", "/", "z"]) for _ in range(rng.randint(0, 4)))
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    rules = list({(host(2), path()): None for _ in range(60)})
    rules = [(h, p, "block" if i % 2 else "allow") for i, (h, p) in enumerate(rules)]
    urls = [f"http://{host(4)}{path()}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules + rules[:5], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, table).collect()}
    for i, url in enumerate(urls):
        want = judged(url, rules)
        assert got[i][:2] == want[:2]
        # Rules of equal length on different hosts: the longer host wins.
        assert (got[i][2] or "") == (want[2] or "") and got[i][3] == want[3]


def test_empty_pages_and_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    row = url_filter.judge_urls(one, rules.limit(0), otherwise="block").first()
    assert (row.rule, row.verdict) == (None, "block")


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    plan = url_filter.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def jump(key, shards):
    before, at = -1, 0
    while at < shards:
        before = at
        key = (key * 2862933555777941757 + 1) % 2**64
        at = int((before + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return before


def test_jump_matches_the_published_loop(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 400)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for shards in (1, 2, 16, 37):
        for row in shard.assign_shards(df, "doc_id", shards).collect():
            key = xxhash.xxh64_intdigest(struct.pack("<q", row.doc_id), seed=42)
            assert (row["shard"], row.grown_shard) == (jump(key, shards), jump(key, shards + 1))
            assert row.grown_shard in (row["shard"], shards)


def test_shard_table(spark):
    texts = ["a", None, "", "é" * 1000, "a", "x" * 300_000] * 20
    rows = [(i if i % 7 else None, t, "z") for i, t in enumerate(texts)] + [(1, "twice", "z")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = shard.shard_table(df, 4, ranges=3).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert len({r["shard"] for r in got if r.doc_id is None}) == 1
    assert shard.shard_table(df.limit(0)).count() == 0
