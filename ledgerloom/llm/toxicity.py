"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns the words of a clause into symbols: insult, threat,
target, negation, report, quote or other. Three small transducers over these symbols
(negation scope, reported speech and quotes, target) are composed into one machine,
which labels every insult and threat of a clause with the context it is in. A
clause scores by its matched patterns, never by a word alone: the contexts' weights
are learnt by a logistic model whose prior is the grammar's own weights.

Words and word beginnings enter the lexicon with the log-odds that labelled
training documents give them, chosen greedily so that each explains toxic documents
which the ones before it don't; fixed seed words serve where labels say nothing.
Training uses at most ``sample`` labelled documents; scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product
from math import ceil, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import released, small_batches, staged

#: Seed words of each symbol.
INSULTS = "idiot moron stupid fool loser scum trash clown pathetic worthless disgusting imbecile dummkopf trottel arschloch crétin imbécile abruti idiota imbécil estúpido basura".split()
THREATS = "kill hurt destroy strangle töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your u he she they him her them du dich dir ihr euch tu te toi vous tú ti usted vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says say claimed reported quoted wrote sagte sagt schrieb dit écrit affirme dijo dice escribió".split()
QUOTES = '"«»“”„'
SEED_WEIGHT = 3.0

TOKEN = re.compile(rf"[\w'’]+|[{QUOTES}]")
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+")
SCOPE = 3  # words a negation reaches
CONTEXTS = ("plain", "targeted", "negated", "reported")
#: The grammar's own weights of a context, the prior of what is learnt.
PRIOR = {"plain": 1.0, "targeted": 1.3, "negated": 0.5, "reported": 0.5}


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arc(state, symbol)`` is (state, output symbol)."""

    start: int
    states: int
    arc: Callable[[int, str], tuple[int, str]]


def negation(state: int, s: str) -> tuple[int, str]:
    if s == "N":
        return SCOPE, "o"
    return max(state - 1, 0), s.lower() + "n" if state and s in ("I", "V") else s


def reporting(state: int, s: str) -> tuple[int, str]:
    """State 1: behind a verb of saying; 2: inside quotes."""
    if s == "R":
        return max(state, 1), "o"
    if s == "Q":
        return (0 if state == 2 else 2), "o"
    return state, s[0].lower() + "r" if state and s[0] in "IViv" else s


def targeting(state: int, s: str) -> tuple[int, str]:
    """State 1: the clause has named whom it is about."""
    if s == "T":
        return 1, "T"
    return state, s + "t" if state and s in ("I", "V") else s


ALPHABET = "ITVNRQo"


def compose(first: Transducer, *others: Transducer) -> dict[tuple[int, str], tuple[int, str]]:
    """One table (state, symbol) -> (state, output) for transducers that run one behind the other."""
    machines = [first, *others]
    states = list(product(*[range(m.states) for m in machines]))
    number = {s: i for i, s in enumerate(states)}
    table = {}
    for state, symbol in product(states, ALPHABET):
        out, after = symbol, []
        for machine, at in zip(machines, state, strict=True):
            at, out = machine.arc(at, out)
            after.append(at)
        table[number[state], symbol] = (number[tuple(after)], out)
    return table


GRAMMAR = compose(Transducer(0, SCOPE + 1, negation), Transducer(0, 3, reporting), Transducer(0, 2, targeting))
OUTPUT = {"I": "plain", "It": "targeted", "V": "", "Vt": "targeted", "in": "negated", "vn": "", "ir": "reported", "vr": ""}


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)  # of insults
    starts: dict[str, float] = field(default_factory=dict)  # beginnings of longer insults
    harmless: frozenset[str] = frozenset()  # words that begin so and are none

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.starts})
        self.symbol = {w: s for s, ws in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("V", THREATS), ("Q", QUOTES)) for w in ws}

    def read(self, token: str) -> tuple[str, float]:
        weight = self.words.get(token, 0.0)
        for n in self.lengths if token not in self.harmless else ():
            if len(token) > n:
                weight = max(weight, self.starts.get(token[:n], 0.0))
        if weight:
            return "I", weight
        s = self.symbol.get(token, "o")
        return s, SEED_WEIGHT if s == "V" else 0.0

    def automaton(self):
        """Finds the texts that can score at all."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in {*self.words, *self.starts, *THREATS}:
            machine.add_word(w, w)
        machine.make_automaton()
        return machine


def clause_features(clause: str, lexicon: Lexicon) -> dict[str, float]:
    """Weight by context of the patterns that match in one clause."""
    state, found = 0, defaultdict(float)
    pending = 0.0  # hits before the target: "idiots, all of you"
    for token in TOKEN.findall(clause):
        symbol, weight = lexicon.read(token)
        state, out = GRAMMAR[state, symbol]
        if out == "T" and pending:
            found["targeted"] += pending
            found["plain"] -= min(pending, found["plain"])
            pending = 0.0
        context = OUTPUT.get(out, "")
        if context:
            found[context] += weight
        if out == "I":
            pending += weight
        elif out == "V":  # a threat needs its target
            pending += weight
    return found


def features(text: str | None, lexicon: Lexicon, machine) -> list[float]:
    """Best clause by the grammar's weights, then the log of the weights in each context."""
    low = (text or "").lower()
    if next(machine.iter(low), None) is None:
        return [0.0] * (1 + len(CONTEXTS))
    best, sums = 0.0, dict.fromkeys(CONTEXTS, 0.0)
    for clause in CLAUSE.split(low):
        if next(machine.iter(clause), None) is None:
            continue
        found = clause_features(clause, lexicon)
        best = max(best, sum(PRIOR[c] * w for c, w in found.items()))
        for c, w in found.items():
            sums[c] += w
    return [min(best, 12.0), *[log1p(max(sums[c], 0.0)) for c in CONTEXTS]]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: list[float]
    bias: float


@dataclass(frozen=True)
class ToxicityRules:
    sample: int = 20_000  # labelled training documents at most
    least: int = 3  # toxic documents that a lexicon entry must explain at least
    share: float = 0.003  # and as a share of the toxic ones
    least_odds: float = 2.0  # log-odds of an entry
    longest_start: int = 8
    pull: float = 0.02  # of the prior, per training document


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by checksum of its id; labels of these are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rules: ToxicityRules, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of labelled documents that aren't held out, thinned by hash to about ``rules.sample``."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where("toxic in (0, 1)").where(~held_out()).where("doc_id is not null")
    one_in = max(1, -(-usable.count() // rules.sample))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")  # about rules.sample rows
    return staged(joined.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").repartition(24), "toxicity-sample")


def word_features(text: str, longest: int, harmless: frozenset[str] = frozenset()) -> set[str]:
    """Words (``=w``) and, but for harmless ones, their beginnings (``^b``)."""
    found = set()
    for w in set(WORD.findall(text.lower())):
        found.add("=" + w)
        if w not in harmless:
            found.update(["^" + w[:n] for n in range(3, min(len(w) - 1, longest) + 1)])
    return found


def counted(rows: DataFrame, longest: int, harmless: frozenset[str] = frozenset(), wanted: frozenset[str] | None = None) -> DataFrame:
    """(feature, n): in how many texts of ``rows`` each feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for batch in batches:
            for text in (t.as_py() for t in batch.column(0)):
                found = word_features(text, longest, harmless)
                n.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["feature", "n"])

    return rows.select("text").mapInArrow(released(count), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame, rules: ToxicityRules) -> Lexicon:
    """Entries chosen greedily on the training rows; seeds that labels contradict are left out."""
    size = dict(rows.groupBy("toxic").count().collect())
    n1, n0 = size.get(1, 0), size.get(0, 0)
    least = max(rules.least, ceil(rules.share * n1))
    toxic = rows.where("toxic = 1")
    clean = rows.where("toxic = 0")
    seeds, longest = ["=" + w for w in INSULTS], rules.longest_start
    usual = counted(clean, 0).where("n >= 2").join(counted(toxic, 0).withColumnRenamed("n", "n1"), "feature", "left").fillna(0)
    usual = usual.where("n1 <= n")
    harmless = frozenset(r[0][1:] for r in usual.select("feature").collect())  # words of at most rules.sample texts
    ones = dict(counted(toxic, longest, harmless).where((F.col("n") >= least) | F.col("feature").isin(seeds)).collect())
    zeros = dict(counted(clean, longest, harmless, frozenset(ones) | frozenset(seeds)).collect())
    odds = {f: log((n + 0.5) / (n1 + 1)) - log((zeros.get(f, 0) + 0.5) / (n0 + 1)) for f, n in ones.items()}
    odds = {f: o for f, o in odds.items() if o >= rules.least_odds and ones[f] >= least}
    wanted = frozenset(odds)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(word_features(t, longest, harmless) & wanted) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["found"])

    left = [set(r[0]) for r in toxic.select("text").mapInArrow(released(sets), "found array<string>").collect()]  # at most rules.sample sets
    entries: dict[str, float] = {}
    while left:
        n = Counter(f for found in left for f in found)
        gain = {f: k * (odds[f] - 1.0) for f, k in n.items() if k >= least}
        if not gain:
            break
        best = min(gain, key=lambda f: (-gain[f], f[0] == "^", -len(f), f))
        entries[best] = odds[best]
        left = [found for found in left if best not in found]
    for f in seeds:
        if f not in entries and not zeros.get(f, 0) * max(n1, 1) > ones.get(f, 0) * max(n0, 1):
            entries[f] = odds.get(f, SEED_WEIGHT)
    words, starts = ({f[1:]: round(w, 4) for f, w in entries.items() if f[0] == kind} for kind in "=^")
    return Lexicon(words, starts, frozenset(w for w in harmless if w.startswith(tuple(starts))))


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn lexicon and context weights from labelled documents that aren't held out."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, rules, id_col, text_col, label_col)
    lexicon = learn_lexicon(rows, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            found = [features(t, lexicon, machine) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    seen = rows.mapInArrow(released(run), "x array<double>, y int").groupBy("x", "y").count().collect()  # at most rules.sample rows
    prior = np.array([0.4, *[PRIOR[c] for c in CONTEXTS]])
    if not seen:
        return ToxicityModel(lexicon, prior.tolist(), -2.0)
    seen = sorted(((tuple(r["x"]), r["y"], r["count"]) for r in seen), key=repr)
    x, y, n = np.array([r[0] for r in seen]), np.array([r[1] for r in seen], float), np.array([r[2] for r in seen], float)
    x = np.column_stack([x, np.ones(len(x))])
    w, centre = np.append(prior, -2.0), np.append(prior, -2.0)
    pull = np.append(np.full(len(prior), rules.pull * n.sum() ** 0.5), 1e-6)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + pull * (w - centre)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(lexicon, [round(float(v), 9) for v in w[:-1]], round(float(w[-1]), 9))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, features) for every row of ``docs``; the score sees the text only.

    ``features`` are those of :func:`features`. Null and empty texts have no match
    and get the model's base score; texts of any length are read whole. Rows that
    share an id are scored each for itself; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.lexicon.automaton()
        for batch in batches:
            x, p = scored((t.as_py() for t in batch.column(1)), model, machine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "score", "features"])

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(released(run), f"doc_id {kind.simpleString()}, score double, features array<double>")


def scored(texts: Iterable[str | None], model: ToxicityModel, machine) -> tuple[list[list[float]], list[float]]:
    x = [features(t, model.lexicon, machine) for t in texts]
    z = np.array(x).reshape(len(x), len(model.weights)) @ np.array(model.weights) + model.bias
    return x, (1 / (1 + np.exp(-np.clip(z, -30, 30)))).round(12).tolist()


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more, all columns kept."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    @released
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = model.lexicon.automaton()
        for texts in batches:
            plain = (t if isinstance(t, str) else None for t in texts)
            yield pd.Series(scored(plain, model, machine)[1], dtype="float64")

    return docs.where(of(F.col(text_col)) < threshold)
