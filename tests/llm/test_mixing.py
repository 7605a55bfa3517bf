import hashlib
import random
import re

from helpers import awkward, documents, empty

from ledgerloom.llm import mixing


def brute(rows, plan=mixing.MixPlan()):
    """{(id): taken} by sorting each source's documents by hash."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r["text"]) for r in rows if r["source"] == s) for s in sources}
    weight = {s: plan.weights[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, plan.budget * sum(sizes.values()), set(sources)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level > plan.cap * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = plan.cap * sizes[s]
            left -= target[s]
        open_ -= full
    taken = {}
    for s in sources:
        mine = sorted((hashlib.md5(f"mix:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:15], size(r["text"]), r["doc_id"]) for r in rows if r["source"] == s)
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        need, total, i = target[s] - whole * sizes[s], 0, 0
        mine = [m for m in mine if m[1]]
        taken |= {m[2]: whole * m[1] for m in mine}
        while need > 0 and i < len(mine):
            group = [m for m in mine if m[0] == mine[i][0]]
            words = sum(m[1] for m in group)
            if total + words >= need and total + words - need > need - total:
                break
            for m in group:
                taken[m[2]] += m[1]
            total, i = total + words, i + len(group)
            if total >= need:
                break
    return target, taken


def test_same_as_sorting(spark):
    random.seed(3)
    sources = [random.choice(["a", "a", "a", "b", "c", None, "é"]) for _ in range(300)]
    docs = documents(spark, ["w " * random.randint(0, 60) for _ in sources], sources)
    target, taken = brute(docs.collect())
    rows = mixing.mix(docs).collect()
    assert len(rows) == 300
    for r in rows:
        assert r["taken"] == taken.get(r["doc_id"], 0) and r["taken"] <= 2 * r["size"]
    by = {r["doc_id"]: r for r in rows}
    for i, s in enumerate(sources):
        assert abs(by[i]["target"] - target[s]) < 1e-6


def test_larger_budgets_contain_smaller_ones(spark):
    docs = documents(spark, ["w " * (i % 7 + 1) for i in range(200)])
    less, more = (dict(mixing.mix(docs, mixing.MixPlan(budget=b)).select("doc_id", "copies").collect()) for b in (0.4, 0.7))
    assert all(more[i] >= n for i, n in less.items()) and sum(more.values()) > sum(less.values())


def test_awkward_and_empty(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == 8 and sum(r["size"] == 0 for r in rows) == 4
    assert mixing.mix(empty(spark)).count() == 0
    kept = mixing.repeated(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert kept.count() == sum(r["copies"] for r in rows)
    assert mixing.repeated(empty(spark)).count() == 0
