"""WARC archives and URL filters."""

import hashlib
import random

import pytest

from sightline.llm import urls, warc


def test_archives_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    odd = "".join(rnd.choice("\r\n\r\nWARC/1.1é") for _ in range(400))
    payloads = [None, "", "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 60, "é" * 60, "a\r\n\r\n", "\r\n" * 80, odd, odd, "z" * 200_000]
    rows = [(100 - i, f"http://h{i}.com/p?q#f" if i % 3 else None, p, 1) for i, p in enumerate(payloads)]
    rows += [(5, "http://a\r\nb/", "twice" * 40, 1), (5, "http://a\r\nb/", "twice" * 40, 1), (9, "u", "twice" * 40, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, per_archive=3)
    got = warc.resolve(warc.assemble(warc.read_archives(spark, path))).collect()
    assert len(got) == len(rows)
    first = {}
    for key, _, p, _ in rows:
        if len((p or "").encode()) >= 100:
            first[p] = min(first.get(p, key), key)
    expected = sorted((k, u is None, p or "", first.get(p, k) if first.get(p, k) != k else None) for k, u, p, _ in rows)
    seen = []
    for r in got:
        own = r.origin or r.response
        body = bytes(own.block).partition(b"\r\n\r\n")[2]
        assert hashlib.sha256(body).hexdigest() == own.payload_digest == r.response.declared_digest and len(body) == own.payload_bytes
        assert r.request.target_uri == r.response.target_uri and int(r.metadata.fields["payload-bytes"]) == len(body)
        assert r.response.record_type == ("revisit" if r.origin else "response")
        seen.append((int(r.metadata.fields["page-id"]), r.response.target_uri is None, body.decode(), r.origin and r.origin.page_id))
    assert sorted(seen, key=str) == sorted(expected, key=str)


def test_empty_table_and_broken_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = str(tmp_path / "none")
    warc.write_archives(pages, path)
    assert warc.assemble(warc.read_archives(spark, path)).collect() == []
    for chunks in ([b"WARC/1.1\r\nContent-Length: 10", b"short"], [b"WARC/1.1\r\nContent-Length: 2", b"long"], [b"no record"]):
        with pytest.raises(ValueError):
            list(warc._parse(iter(chunks)))


def plain_rule(host, path):
    fits = [r for _, r in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_rules_hosts_and_verdicts(spark):
    rnd = random.Random(2)
    hosts = ["a.Example.NET", "example.com", "x.example.com", "notexample.com", "q.org", "net", "b.net", "cheap-pills.org", "casinowin.com", "newsreader.com", "ünïcode.org", "l" * 80 + ".com"]
    paths = ["", "/", "/en/", "/en", "/de/a?x://y/", "/fr/#b", "/FR/", "/cheap/5", "?q=/en/", "#/de/"]
    rows = [(i, f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}", "<p>news reader casino win cheap pills code</p> " * 3) for i in range(300)]
    rows += [(900, None, None), (901, "nothing", ""), (902, "x\ny://A.org/fr/z", "x"), (902, "x\ny://A.org/fr/z", "x")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = urls.filter_urls(pages).collect()
    assert len(got) == len(rows)
    by_id = {k: u for k, u, _ in rows}
    for r in got:
        _, found, rest = (by_id[r.page_id] or "").partition("://")
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (r.host, r.path, r.rule) == (host, path, plain_rule(host, path))
        assert r.verdict in ("allow", "block")
        if r.rule:
            assert (r.verdict, r.rule) in urls.RULES
        elif "pills" in host or "casino" in host:
            assert r.verdict == "block"
        elif not any(s in host for s in urls.SEEDS):
            assert r.verdict == "allow", r
    words = {r.host: r.host_words for r in got}
    assert words["casinowin.com"][:2] == ["casino", "win"] and words["newsreader.com"][:2] == ["news", "reader"]
    assert urls.filter_urls(pages.limit(0)).collect() == []


def test_segmentation_is_the_most_probable():
    known, total = {"the": 50, "then": 5, "news": 20, "new": 10, "s": 3, "reader": 9, "read": 9, "er": 4}, 200

    def splits(s):
        yield [s] if s else []
        for i in range(1, len(s)):
            for rest in splits(s[i:]):
                yield [s[:i], *rest]

    import math

    def score(words):
        return sum(math.log(known[w] / total) if w in known else -math.log(total) - len(w) * math.log(10) for w in words)

    for label in ("newsreader", "thenews", "xthe", "zq"):
        assert score(urls.segment(label, known, total)) == pytest.approx(max(map(score, splits(label))))
