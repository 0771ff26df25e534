import random
import re

from pyspark.sql import functions as F

from quire.llm import url_filter as uf

URLS = [None, "", "no scheme.com/en/", "http://example.com/en/x", "HTTPS://WWW.EXAMPLE.COM/en/1?q=/fr/#x", "ftp://a.b.net/es/", "http://net/fr/", "http://evilnet/fr/", "http://x.org/a.com/", "http://com", "http://com/", "http://a.com?x=/en/", "http://ÄB.example.com/en/é", "://", "a://b://c.com/x", "http://example.com/EN/x", "http:///es/", "http://x.net/es", "http://" + "a" * 3000 + ".com/" + "p" * 3000]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        path = re.match(r"[^?#]*", tail, re.S)[0]
    fits = [(len(r), v, r) for v, r in uf.RULES if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_rules_over_edge_cases(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").withColumns({"rule": F.lit(1), "html": F.lit(None)})
    rows = uf.filter_urls(df).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == expected(URLS[r.page_id])
    assert uf.filter_urls(df.where("false")).count() == 0


def test_many_words_of_patterns_agree_with_single_matches():
    rng = random.Random(5)
    globs = [re.sub(r"\*+", "*", "".join(rng.choice("ab/?*") for _ in range(rng.randint(1, 9)))) for _ in range(80)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    found = uf.Automaton(globs).first([t.encode() for t in texts])
    regexes = [re.compile("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in g) + r"\Z") for g in globs]
    assert uf.Automaton(globs).words > 1
    assert found.tolist() == [next((i for i, r in enumerate(regexes) if r.match(t)), -1) for t in texts]
    assert uf.Automaton([]).first([b"x"]).tolist() == [-1]


def test_the_few_longest_go_on_alone(monkeypatch):
    rng = random.Random(6)
    globs = [re.sub(r"\*+", "*", "".join(rng.choice("ab/?*") for _ in range(rng.randint(1, 9)))) for _ in range(80)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 40))).encode() for _ in range(200)]
    states = []
    for few in (0, 4, 1000):
        monkeypatch.setattr(uf, "FEW", few)
        states.append(uf.Automaton(globs).states(texts).tolist())
    assert states[0] == states[1] == states[2]
    monkeypatch.setattr(uf, "FEW", 4)
    assert uf.Automaton(["a/**z"]).first([b"a/" + b"x/" * 500_000 + b"z", b"a/x"]).tolist() == [0, -1]


def test_double_star_and_escapes():
    a = uf.Automaton(["a/**", r"\*b", "**z"])
    assert a.first([b"a/b/c", b"*b", b"xb", b"a/z", b"q/z", b"a"]).tolist() == [0, 1, -1, 0, 2, -1]
