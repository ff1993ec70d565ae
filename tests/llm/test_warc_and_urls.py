import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from voxelark.llm import url_filter, warc


def pages(spark):
    rows = [(k, f"http://h{k % 3}.example.com/en/{k}", f"<p>{k % 4}</p>" * 50) for k in range(30)]
    rows += [(40, None, None), (41, "no url", ""), (42, "http://x/\r\nevil: 1", "Ünï" * 100_000), (None, "http://a.org/es/", "<p>1</p>" * 50), (7, "http://again/", "<p>3</p>" * 50)]
    return spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3), rows


@pytest.mark.parametrize("few", [True, False])
def test_round_trip(spark, monkeypatch, few):
    if not few:  # as when revisits are too many to broadcast
        monkeypatch.setattr(warc, "small", lambda rows, most: rows)
    df, rows = pages(spark)
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in warc.round_trip(df).collect())
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = i is not None and top[h or ""] != i
        want.append((-1 if i is None else i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else -1))
    assert got == sorted(want)
    assert warc.round_trip(df.filter("false")).count() == 0


def test_urls_come_back(spark):
    urls = ["http://x/\r\nevil: 1", "a\\b", 'q"\t"\\u0041', " spaced ", "http://é.例/", "x: y", "\x85\u2028", None]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert [r["url"] for r in warc.round_trip(df).orderBy("page_id").collect()] == urls


def test_members_are_records(spark, tmp_path):
    df, rows = pages(spark)
    whole = warc.write_archives(df.coalesce(1), f"file://{tmp_path}/whole")
    (new,) = warc.normalise(spark, whole, f"file://{tmp_path}/new")
    raw = open(new.removeprefix("file://"), "rb").read()
    places = [tuple(map(int, x.split())) for x in open(new.removeprefix("file://") + ".idx")]
    assert len(places) == len(rows) and sum(n for _, n in places) == len(raw)
    parts = [gzip.decompress(raw[a : a + n]) for a, n in places]
    assert b"".join(parts) == gzip.decompress(open(whole[0].removeprefix("file://"), "rb").read())
    assert all(p.startswith(b"WARC/1.1\r\n") for p in parts)


def fits(rule, host, path):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_urls_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://com/en/", "HTTP://A.Example.COM/en/7?x", "https://xexample.com/en/7", "http://b.example.com#/en/", "http://example.com:80/en/1", "a://b://com/en/", "http://example.net/de/8", "http://sub.de.net/de/", "http://org/es", "http://.com/en/x", "http://com./en/x", "http://a.b.c.org/es/\nq"] * 3
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, key string")
    rules = [*url_filter.CONTRACT_RULES, ("b.c.org", "", "block"), ("example.com", "/en/7", "block"), ("", "/x", "block"), ("example.com", None, "allow")]
    r = spark.createDataFrame(rules, "host string, path string, action string")
    for size in (100_000, 2):
        for x in url_filter.judge_urls(df, r, rules_per_group=size).collect():
            u = urls[x["page_id"]] or ""
            rest = u.split("://", 1)[1] if "://" in u else ""
            cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
            host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
            path = rest[cut:].split("?")[0].split("#")[0]
            assert (x["host"], x["path"]) == (host, path)
            best = max(((len(h) + len(p or ""), len(h), h + (p or ""), a) for h, p, a in rules if h and fits((h, p or ""), host, path)), default=None)
            assert (x["rule"], x["verdict"]) == ((best[2], best[3]) if best else (None, "allow"))
    assert url_filter.judge_urls(df, r).count() == len(urls) == url_filter.judge_urls(df, r.filter("false")).count()
    assert url_filter.judge_urls(df.filter(F.lit(False)), r).count() == 0
