import random

from pyspark.sql import functions as F

from ledgerloom.llm import urllists


def brute(captures, entries):
    known = {}
    for domain, category, at, listed in entries:
        if None not in (domain, category, at):
            key = (domain.lower(), category, min(max(at, 0), urllists.FOREVER))
            known[key] = known.get(key, False) or bool(listed)
    out = []
    for host, at in captures:
        labels = host.split(".")
        hits = []
        for i in range(max(len(labels) - 1, 1)):
            domain = ".".join(labels[i:])
            for category in {c for d, c, _ in known if d == domain}:
                past = [(t, on) for (d, c, t), on in known.items() if d == domain and c == category and t <= at]
                if past and max(past)[1]:
                    hits.append((-len(domain), category, domain))
        out.append(min(hits)[1:] if hits else None)
    return out


def test_against_brute_force_with_busy_domains(spark):
    random.seed(7)
    domains = ["a.com", "b.a.com", "c.org", "x.y.c.org", "single"]
    entries = [(random.choice(domains), random.choice(["spam", "adult"]), random.randint(0, 5000), random.random() < 0.6) for _ in range(400)] + [(None, "spam", 3, True), ("a.com", None, 3, True), ("c.org", "spam", None, True)]
    captures = [(random.choice(["www.b.a.com", "a.com", "c.org", "z.x.y.c.org", "single", "other.net"]), random.randint(0, 6000)) for _ in range(300)]
    e = spark.createDataFrame(entries, "domain string, category string, at long, listed boolean")
    c = spark.createDataFrame([(i, f"https://u@{h.upper()}:8080/p?q#f", t) for i, (h, t) in enumerate(captures)], "i long, url string, fetched_at long")
    want = brute(captures, entries)
    spans = urllists.intervals(e)
    for busy in (0, 64, 10_000):
        keys = c.select(urllists.host_of(F.col("url")).alias("host"), "fetched_at").distinct()
        found = urllists.active(keys, spans, busy)
        best = {}
        for r in found.collect():
            key = (r["host"], r["fetched_at"])
            best[key] = min(best.get(key, (0, "~", "~")), (-len(r["domain"]), r["category"], r["domain"]))
        assert [best.get(x) and best[x][1:] for x in captures] == want
    rows = urllists.judge(c, e).orderBy("i").collect()
    assert [(r["verdict"]["category"], r["verdict"]["domain"]) if r["verdict"]["blocked"] else None for r in rows] == want


def test_dyadic_pieces_make_up_the_interval(spark):
    random.seed(8)
    spans = [(0, urllists.FOREVER), (5, 6), (0, 1 << 32)] + [tuple(sorted(random.sample(range(1 << 20), 2))) for _ in range(50)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", urllists._pieces(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        pieces = sorted((x["p"] << x["k"], (x["p"] + 1) << x["k"]) for x in r["p"])
        assert pieces[0][0] == r["a"] and pieces[-1][1] == r["b"] and all(x[1] == y[0] for x, y in zip(pieces, pieces[1:]))


def test_odd_captures(spark):
    e = spark.createDataFrame([("a.com", "spam", 10, True)], "domain string, category string, at long, listed boolean")
    rows = [(1, None, 20), (2, "no url", 20), (3, "http://a.com", None), (4, "http://a.com.", 20), (4, "http://a.com.", 20), (5, "http://a.com", 9), (6, "ftp://aa.com/a.com", 20), (7, "", 1)]
    c = spark.createDataFrame([(*r, "x", "y") for r in rows], "i long, url string, fetched_at long, verdict string, host string")
    out = urllists.judge(c, e)
    assert sorted(out.columns) == sorted(c.columns)
    assert sorted((r["i"], r["verdict"]["blocked"]) for r in out.collect()) == [(1, False), (2, False), (3, False), (4, True), (4, True), (5, False), (6, False), (7, False)]
    assert urllists.judge(c.where("i < 0"), e).count() == 0
    assert urllists.judge(c, e.where("at < 0")).where("verdict.blocked").count() == 0


def test_a_host_of_over_253_characters_is_none(spark):
    host = ".".join(["a" * 49] * 5)  # 249 characters
    rows = [(1, f"http://{host}/x"), (2, f"http://bbbb.{host}/x"), (3, "http://" + "a." * 200_000 + "com/")]
    hosts = spark.createDataFrame(rows, "id long, url string").select("id", urllists.host_of(F.col("url")).alias("h")).collect()
    assert {r["id"]: r["h"] for r in hosts} == {1: host, 2: None, 3: None}


def test_the_host_stands_behind_the_last_at(spark):
    urls = ["http://a@b@evil.com/x", "http://user:p@ss@evil.com:80", "http://evil.com/@home", "http://a@/x", "http://x@y"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    assert [r[0] for r in df.orderBy("i").select(urllists.host_of(df["url"])).collect()] == ["evil.com", "evil.com", "evil.com", None, "y"]
