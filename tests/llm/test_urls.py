import re

from sparkobs.llm import urls
from sparkobs.llm.queries import URL_RULES


def brute(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in URL_RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    best = max(fit, key=lambda r: len(r[0]), default=(None, None))
    return host, path, *best


def test_against_brute_force(spark):
    given = [None, "", "no scheme", "http://a.net", "http://A.NET/x", "https://example.net/en/1", "https://Sub.Example.net/en/a?b#c", "http://example.net/en", "http://notexample.com/de/", "http://x.example.com/de/7", "http://b.org/fr/1", "http://org/fr/", "ftp://h\n/p?q://z", "http://é.com/Ä", "://", "http://" + "a" * 50000 + ".net/z"]
    good, bad = [f"http://site{i}.org/fr/article-about-things-{i * 7}" for i in range(300)], [f"http://spam{i}.net/xxx/win?cash={i}" for i in range(300)]
    new = ["http://other.info/fr/article-about-things-99999", "http://spam777.info/xxx/win?cash=777"]
    rows = given + good + bad + new + given
    df = spark.createDataFrame([(i, u, "s") for i, u in enumerate(rows)], "page_id long, url string, score string")
    got = {r.page_id: r for r in urls.judge(df, URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(rows):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert got[rows.index(new[0])].verdict == "allow" and got[rows.index(new[1])].verdict == "block"
    assert got[0].score == got[1].score == 0
    assert urls.judge(df.limit(0), URL_RULES).count() == 0
    alone = urls.judge(df.where("page_id = 2"), URL_RULES).collect()
    assert [(r.verdict, r.score) for r in alone] == [("allow", 0.0)]


def test_grams_of_segments_are_those_of_the_whole(monkeypatch):
    whole = urls.segments("http://a/b" * 9) + urls.segments("")
    contexts, chars, whose = urls.grams(whole)
    assert contexts.shape == (urls.ORDER + 1, 92) and whose.tolist() == [0] * 91 + [1]
    monkeypatch.setattr(urls, "SEGMENT", 7)
    parts = urls.segments("http://a/b" * 9) + urls.segments("")
    assert len(parts) == 14 and (urls.grams(parts)[1] == chars).all() and (urls.grams(parts)[0] == contexts).all()


def test_long_urls_are_scored_as_ever_in_small_segments(spark, monkeypatch):
    rows = [f"http://site{i}.org/fr/{i * 7919}" for i in range(60)] + [f"http://spam{i}.net/{i * 104729}" for i in range(60)] + ["http://q.info/" + "abc" * 700, "http://q.info/x"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    whole = {r.page_id: r.score for r in urls.judge(df, URL_RULES).collect()}
    monkeypatch.setattr(urls, "SEGMENT", 50)
    assert {r.page_id: r.score for r in urls.judge(df, URL_RULES).collect()} == whole
