import random
import re
from collections import Counter
from math import exp, log

from helpers import awkward, documents, empty
from pyspark.sql import functions as F

from ledgerloom.llm import pii


def base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_against_brute_force(spark):
    random.seed(5)
    sets = ["0123456789", "0123456789. -", "+()0123 9", "ab@.-_%", "a@b.c 1", "\u0001\u0004é ß\n😀"]
    texts = ["".join(random.choice(random.choice(sets)) for _ in range(random.randint(0, 90))) for _ in range(1500)]
    texts += ["1 " * 20000 + "x", "a" * 60000 + "@", "a.b@" * 3000 + "c.d", "1.2.3.4.5.6.7.8.9" * 50, "a@b.c_d@e.f", None, "", "4111 1111 1111 1111", "x 00001.2.3.4"]
    rows = pii.candidates(documents(spark, texts)).select("doc_id", pii.listed(F.filter("spans", lambda s: s["base"])).alias("b")).collect()
    for r in rows:
        assert r["b"] == ",".join(f"{k}:{a}:{z}" for k, a, z in base(texts[r["doc_id"]] or "")), texts[r["doc_id"]]


def test_votes_tell_secrets_from_words(spark):
    random.seed(1)
    secret = lambda: "".join(random.choice("0123456789abcdef") for _ in range(40))
    texts = [f'some token = "{secret()}" here' for _ in range(40)] + [f"mail joe{i}@example.com or 10.1.{i}.7" for i in range(40)] + ["card 4111111111111112 fails", "plain words only"]
    found = pii.candidates(documents(spark, texts).select("doc_id", "text")).select("doc_id", "spans")
    model = pii.fit(found)
    rows = {r["doc_id"]: r["spans"] for r in pii.decided(found, model).collect()}
    assert all(len(rows[i]) == 1 and pii.KINDS[rows[i][0]["kn"]] == "secret" for i in range(40))
    assert all(len(rows[i]) == 2 for i in range(40, 80)) and rows[80] == [] and rows[81] == []
    assert all(0 <= r <= 1 for r in model.reliability.values())


def test_redaction(spark):
    texts = ["mail a@b.com, 4111 1111 1111 1111 and +1 (243) 555-5526.", None, "", "é 1.2.3.4", "nothing"]
    rows = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts)).collect()}
    assert rows == {0: "mail <EMAIL>, <CARD> and <PHONE>.", 1: None, 2: "", 3: "é <IP>", 4: "nothing"}


def test_awkward_and_empty(spark):
    assert pii.find(awkward(spark)).count() == 8
    assert pii.redact(awkward(spark)).columns == awkward(spark).columns
    assert pii.find(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_many_spans_in_one_long_text(spark):
    n = 8000
    text = "".join(f"a 192.168.{i % 256}.{i % 200} b" for i in range(n)) + "\n" + "".join(f"555-123-{1000 + i % 9000} +1 555 123 {1000 + i % 9000}; " for i in range(300))
    docs = documents(spark, [text, "x 1.2.3.4"])
    rows = pii.candidates(docs).select("doc_id", pii.listed(F.filter("spans", lambda s: s["base"])).alias("b")).collect()
    assert {r["doc_id"]: r["b"].split(",") for r in rows} == {i: [f"{k}:{a}:{z}" for k, a, z in base(t)] for i, t in enumerate([text, "x 1.2.3.4"])}
    new = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert new[1] == "x <IP>" and new[0].startswith("a <IP> ba <IP> b") and new[0].count("<IP>") == n and new[0].count("<PHONE>") >= 300
    assert not re.search(r"192|\+1", new[0])


def decisions(rows, rules):
    """Which candidates the method accepts, from their votes and features, in plain Python."""
    spans = [s for r in rows for s in r["spans"]]
    counts = Counter((s["kn"], s["votes"]) for s in spans)
    p = {k: 1 / (1 + 3.0 ** (2 * k[1].count("-") - k[1].count("+"))) for k in counts}
    for _ in range(rules.rounds):
        share = {}
        for y in (0, 1):
            weight = {k: n * (p[k] if y else 1 - p[k]) for k, n in counts.items()}
            for j in range(6):
                for v in "+0-":
                    share[y, j, v] = (1 + sum(w for (_, votes), w in weight.items() if votes[j] == v)) / (3 + sum(weight.values()))
            for kn in range(6):
                share[y, kn] = 1 + sum(w for (k, _), w in weight.items() if k == kn)
        p = {(k, votes): 1 / (1 + exp(log(share[0, k] / share[1, k]) + sum(log(share[0, j, v] / share[1, j, v]) for j, v in enumerate(votes)))) for k, votes in counts}
    yes, no = sum(counts[k] * p[k] for k in counts), sum(counts[k] * (1 - p[k]) for k in counts)
    seen = [Counter(), Counter()]
    for s in spans:
        for f in set(s["feats"]):
            seen[1][f] += p[s["kn"], s["votes"]]
            seen[0][f] += 1 - p[s["kn"], s["votes"]]
    weight = lambda f: log((seen[1][f] + 1) / (yes + 2)) - log((seen[0][f] + 1) / (no + 2))
    accepted = lambda s: s["base"] or not s["final"] and log((yes + 1) / (no + 1)) + sum(map(weight, set(s["feats"]))) >= 0
    clear = lambda s, all_: s["base"] or not any(b["base"] and b["start"] < s["end"] and s["start"] < b["end"] for b in all_)
    return {r["doc_id"]: sorted((s["kn"], s["start"], s["end"], s["base"]) for s in r["spans"] if accepted(s) and clear(s, r["spans"])) for r in rows}


def test_decisions_against_plain_python(spark):
    rules = pii.PiiRules()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = ["tel 555-123-4567 and +1 555-123-4567", "password: abcdefghijklmnopqrstuv", "joe [at] example [dot] com, joe@example.com", "DE89 3704 0044 0532 0130 00", "key = 0123456789abcdef0123 1.2.3.4"]
    docs = docs.unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(extra * 3)], "doc_id long, text string"))
    found = pii.candidates(docs, rules).select("doc_id", "spans").persist()
    want = decisions(found.collect(), rules)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs, rules).collect()}
    assert got == want and sum(not s[3] for spans in got.values() for s in spans) > 5
