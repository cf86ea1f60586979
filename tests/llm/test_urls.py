import re

from veriflate.llm import urls as M

SCHEMA = "page_id long, url string, html string, host string, rule string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in M.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_parts_and_rules(spark):
    urls = [None, "", "x", "http://A.Example.org/es/x?y", "https://x.com/fr/a://b", "s://example.org/en/12#t", "http://org", "HTTP://org/", "a://b.orgs/", "a://ÉX.com/de/é", "x://y.com/de", "q://example.org/es", "://example.org/en/1"]
    out = M.judged(frame(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()
    verdicts = {r: v for v, r in M.RULES}
    for r in out:
        assert (r.host, r.path, r.rule) == brute(urls[r.page_id])
        assert r.rule is None or r.verdict == verdicts[r.rule]


def test_propagation(spark):
    pages = [(1, "http://bad.com/de/1", '<a href="http://hub.net/">'), (2, "http://farm.net/", "<a href='http://bad.com/x'><a href=//hub.net>"), (3, "http://good.org/a", '<A HREF="https://Friend.net/p">'), (4, "http://friend.net/", ""), (5, "http://hub.net/", None), (6, "http://alone.net/", "")]
    out = {r.page_id: r for r in M.judged(frame(spark, pages + pages[:1])).collect()}
    assert out[2].verdict == "block" and out[2].distrust > 0  # it links to a blocked host
    assert out[4].verdict == "allow" and out[4].trust > 0
    assert out[6].verdict == "allow" and out[6].trust == out[6].distrust == 0


def test_ranks_against_brute_force(spark, monkeypatch):
    ranks_against_brute_force(spark)
    monkeypatch.setattr(M, "SPLIT", 1)
    ranks_against_brute_force(spark)


def ranks_against_brute_force(spark):
    hosts = spark.createDataFrame([("a", 3, 0), ("b", 0, 2), ("c", 0, 0)], "host string, allowed long, blocked long")
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 3), ("c", "a", 1), ("c", "c", 9)], "src string, dst string, weight long")
    got = {r.host: (r.trust, r.distrust) for r in M.ranks(hosts, links).collect()}
    step = {"a": {"b": 0.25, "c": 0.75}, "c": {"a": 1.0}}
    back = {"b": {"a": 1.0}, "c": {"a": 1.0}, "a": {"c": 1.0}}

    def walk(edges, seed, rounds):
        rank = {h: 0.15 * s for h, s in seed.items()}
        for _ in range(rounds):
            new = {h: 0.15 * s for h, s in seed.items()}
            for s, out in edges.items():
                for d, p in out.items():
                    new[d] = new.get(d, 0) + 0.85 * p * rank.get(s, 0)
            rank = new
        return rank

    def apart(rounds):
        trust, distrust = walk(step, {"a": 1.0}, rounds), walk(back, {"b": 1.0}, rounds)
        return max(max(abs(got[h][0] - trust.get(h, 0)), abs(got[h][1] - distrust.get(h, 0))) for h in "abc")

    assert min(apart(n) for n in range(M.STRIDE, 100, M.STRIDE)) < 1e-9
    assert apart(500) < M.SETTLED


def test_long_pages_and_like_names(spark):
    long = "http://" + "h" * 30_000 + ".net/" + "p" * 50_000
    html = " ".join(f'<a href="http://site{i}.net/">' for i in range(5000))
    rows = [(1, long, html, 1.0, 2.0, "x", 9), (2, "http://site7.net/", None, 1.0, 2.0, "x", 9), (None, "http://good.org/", '<a href="//site9.net">', 1.0, 2.0, "x", 9)]
    out = {r.page_id: r for r in M.judged(spark.createDataFrame(rows, "page_id long, url string, html string, trust double, distrust double, _ruled string, links long")).collect()}
    assert out[1].host == "h" * 30_000 + ".net" and out[1].path == "/" + "p" * 50_000
    assert out[None].verdict == "allow" and out[2].verdict == "allow" and len(out) == 3


def test_empty(spark):
    assert M.judged(frame(spark, [])).count() == 0
