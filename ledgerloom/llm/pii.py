"""Personal data by weak supervision. SQL functions only.

Patterns propose candidate spans. Six labelers (checksum, shape, gazetteer, left
context, isolation, variety of characters) vote for, against or abstain on each.
Expectation-maximisation over the counted vote patterns estimates how reliable
each labeler is and gives every pattern a probability; with these as soft labels
a naive Bayes classifier over hashed span features is trained. What the base rules
accept always stays; candidates they don't know are added where the classifier
says so. A failed checksum or range is final.

The vote patterns and the classifier's buckets are bounded by constants, so only
they reach the driver; their counts run over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, staged, text_or_empty

#: The kinds, base ones first, in the order of the results.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE_KINDS = KINDS[:4]
OPEN, CLOSE, OTHER, JOINT = "\u0001", "\u0002", "\u0003", "\u0004"

# Base patterns. The look-behinds only spare the engine starts inside a run that has already
# failed; a match may still begin where the last one ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = f"[0-9][0-9{JOINT}]++"  # after a single space or hyphen between digits became JOINT
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"

# Candidates beyond the base patterns; group 1 is left alone, group 2 is the span.
MASKED_EMAIL = r"()((?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4})"
LOCAL_PHONE = r"(^|[^0-9A-Za-z+().-])(\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9-])"
IP6 = r"(^|[^0-9A-Za-z:.])((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"
IBAN = r"(^|[^0-9A-Za-z])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
SECRET = r"((?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\x20]{0,4}[=:][\x20]{0,4}[\"']?)([A-Za-z0-9_/+=-]{16,})"

#: What the gazetteer and the context labeler know.
TLDS = "com org net edu gov mil int info biz io co uk de fr es it nl be at ch se no dk fi pl pt eu us ca au jp in br".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
PRIVATE = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\."
CUES = r"(?i)(?:mail|contact|kontakt|tel|phone|call|fax|mobil|ip|host|server|addr|card|visa|karte|carte|tarjeta|iban|konto|token|secret|passw|key)[^\n]{0,12}$"
LABELERS = 6

SPAN = "struct<kn:int,start:bigint,end:bigint,base:boolean,final:boolean,votes:string,feats:array<int>>"
MATCH = "struct<start:bigint,end:bigint,m:string,before:string,behind:string>"
STRETCH = 64
SEGMENT = 1024


@dataclass(frozen=True)
class PiiRules:
    rounds: int = 25  # of expectation-maximisation
    buckets: int = 4096  # hashed span features
    smoothing: float = 1.0
    accept: float = 0.5


# The expressions below are SQL text: a span takes hundreds of functions, and each would be a call of its own to the JVM.


def _q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, use: str) -> str:
    """``use``, with ``name`` standing for ``value``, which is computed once although ``use`` may read it in another function's steps."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _running(values: str, zero: str, op: str) -> str:
    """At each place the reduction by ``op`` (of ``a`` and ``x``) of all values before it, in stretches of ``STRETCH``, so that long arrays take no quadratic time."""
    at = lambda i: f"cast(floor(({i}) / {STRETCH}) as int)"
    reduced = lambda part, start: f"aggregate({part}, {start}, (a, x) -> {op})"
    sums = f"transform(sequence(0, {at('size(v) - 1')}), b -> {reduced(f'slice(v, b * {STRETCH} + 1, {STRETCH})', zero)})"
    heads = f"transform(sequence(0, size(s) - 1), b -> {reduced('slice(s, 1, b)', zero)})"
    inside = f"transform(v, (y, i) -> {reduced(f'slice(v, {at("i")} * {STRETCH} + 1, i % {STRETCH})', f'get(h, {at("i")})')})"
    return _let(values, "v", f"if(size(v) > 0, {_let(_let(sums, 's', heads), 'h', inside)}, v)")


def _matches(col: str, pattern: str, replacement: str = f"{OPEN}$0{CLOSE}") -> str:
    """The matches of a pattern with their places in code points, in order, with the 24 characters before and the one behind."""
    parts = f"split(regexp_replace({col}, {_q(pattern)}, {_q(replacement)}), '[{OPEN}{CLOSE}]')"
    before = f"translate(right(array_join(slice(p, greatest(j - 12, 0) + 1, least(j, 12)), ''), 24), '{JOINT}', ' ')"  # six matches have 24 characters
    behind = "left(concat(get(p, j + 1), coalesce(get(p, j + 2), '')), 1)"
    one = f"named_struct('start', get(at, j), 'end', get(at, j) + char_length(get(p, j)), 'm', get(p, j), 'before', {before}, 'behind', {behind})"
    starts = _running("transform(p, x -> cast(char_length(x) as bigint))", "0L", "a + x")
    return _let(parts, "p", f"if(size(p) > 1, {_let(starts, 'at', f'transform(sequence(1, size(p) - 2, 2), j -> {one})')}, cast(array() as array<{MATCH}>))")


def _luhn(digits: str) -> str:
    figures = f"transform(array_remove(split(reverse({digits}), ''), ''), (c, i) -> cast(c as int) * if(i % 2 = 1, 2, 1))"
    return f"aggregate({figures}, 0, (a, x) -> a + if(x > 9, x - 9, x)) % 10 = 0"


def _vote(for_: str, against: str = "false") -> str:
    return f"case when {for_} then '+' when {against} then '-' else '0' end"


def _like(text: str, pattern: str) -> str:
    return f"({text} rlike {_q(pattern)})"


def _among(text: str, values: list[str]) -> str:
    return f"({text} in ({', '.join(map(_q, values))}))"


def _span(kind: str, rules: PiiRules, good: str | None) -> str:
    """The candidate of a match ``m``: its place, the labelers' votes and its hashed features. ``good``: whether a base rule accepts it; None without such a rule."""
    shape = {
        "email": _like("tail", "^[a-z]{2,24}$"),
        "ip": f"(not {_like('m.m', r'(?:^|[.])0[0-9]')} and {_like('m.m', '[0-9]{2,}|:')})",
        "card": "(length(d) in (15, 16))",
        "phone": "(length(d) between 10 and 13)",
        "iban": "(length(replace(m.m, ' ', '')) between 15 and 34)",
        "secret": f"(length(m.m) >= 20 and {_like('m.m', '[0-9]')} and {_like('m.m', '[A-Za-z]')})",
    }[kind]
    code = r"regexp_extract(m.m, '^[+]([0-9]{1,3})', 1)"
    known = {
        "email": _vote(_among("tail", TLDS)),
        "ip": _vote(f"not {_like('m.m', PRIVATE)}", _like("m.m", PRIVATE)),
        "card": _vote(_like("d", ISSUERS), f"not {_like('d', ISSUERS)}"),
        "phone": _vote(f"{_among(code, CALLING)} or {_among(f'substring({code}, 1, 2)', CALLING)} or {_among(f'substring({code}, 1, 1)', ['1', '7'])}"),
        "iban": _vote(_like("m.m", "^(?:DE|FR|ES|IT|NL|BE|AT|CH|GB|PT|PL|SE|NO|DK|FI|IE|LU)")),
        "secret": _vote(_like("m.m", "^(?:ghp_|sk_|pk_|AKIA|xox)")),
    }[kind]
    variety = "size(array_distinct(split(lower(m.m), '')))"
    joined = f"{_like('m.before', '[' + chr(92) + 'p{L}0-9]$')} or {_like('m.behind', '^[' + chr(92) + 'p{L}0-9]')}"
    checked = "'0'" if good is None else f"if({good}, '+', '-')"
    votes = f"concat({checked}, {_vote(shape, f'not {shape}')}, {known}, {_vote(_like('m.before', CUES))}, {_vote(f'not ({joined})', joined)}, {_vote(f'{variety} >= 5', f'{variety} < 5')})"
    form = "regexp_replace(regexp_replace(regexp_replace(m.m, '[0-9]+', '9'), '[A-Z]+', 'A'), '[a-z]+', 'a')"
    word = f"lower(regexp_extract(m.before, {_q(r'(\p{L}+)[^\p{L}]*$')}, 1))"
    mark = f"regexp_replace(regexp_replace(m.behind, {_q(r'\p{L}')}, 'a'), '[0-9]', '9')"
    words = {"n": "cast(length(m.m) as string)", "f": f"substring({form}, 1, 24)", "l": word, "r": mark}
    feats = ", ".join(f"cast(pmod(xxhash64(concat('{kind} {k} ', {w})), {rules.buckets}) as int)" for k, w in words.items())
    base, final = ("false", "false") if good is None else (good, f"not {good}")
    made = f"named_struct('kn', {KINDS.index(kind)}, 'start', m.start, 'end', m.end, 'base', {base}, 'final', {final}, 'votes', {votes}, 'feats', array({feats}))"
    tail = f"element_at(split(lower(m.m), {_q('[^a-z0-9-]+')}), -1)"
    return _let("regexp_replace(m.m, '[^0-9]', '')", "d", _let(tail, "tail", made) if kind == "email" else made)


def candidates(docs: DataFrame, rules: PiiRules = PiiRules(), text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with ``name``: the base spans and candidates of every text, by kind, then place."""
    plain, dashed = free_name(docs, "plain"), free_name(docs, "dashed")
    clean = F.translate(text_or_empty(text_col), OPEN + CLOSE + JOINT, OTHER * 3)
    some = F.when(clean.rlike("[0-9@]|[)\\]]|(?i:token|secret|passw|key)"), clean)  # others have no candidate of any kind
    df = docs.withColumn(plain, some)
    df = df.withColumn(dashed, F.when(F.col(plain).rlike("[0-9]"), F.regexp_replace(F.col(plain), r"(?<=[0-9])[ -](?=[0-9])", JOINT)))
    empty = f"cast(array() as array<{SPAN}>)"

    def base(kind: str, col: str, pattern: str, ok: str, when: str = "true", least: int = 0) -> str:
        """Spans of matches with ``least`` characters or more; those that fail ``ok`` are final."""
        found = _matches(col, pattern)
        found = f"filter({found}, m -> m.end - m.start >= {least})" if least else found
        return f"if({when}, coalesce(transform({found}, m -> {_let(ok, 'good', _span(kind, rules, 'good'))}), {empty}), {empty})"

    def more(kind: str, pattern: str, when: str) -> str:
        found = f"transform({_matches(plain, pattern, f'$1{OPEN}$2{CLOSE}')}, m -> {_span(kind, rules, None)})"
        return f"if({_like(plain, when)}, coalesce({found}, {empty}), {empty})"

    digits = f"translate(m.m, '{JOINT}', '')"
    lists = [
        base("email", plain, EMAIL, "true", f"contains({plain}, '@')"),
        more("email", MASKED_EMAIL, r"[\[(] ?at ?[\])]"),
        base("ip", plain, IP, f"forall(split(m.m, '[.]'), p -> {_like('p', BYTE)})"),
        more("ip", IP6, "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
        base("card", dashed, CARD, f"length({digits}) between 13 and 19 and {_luhn(digits)}", least=13),
        base("phone", plain, PHONE, "length(regexp_replace(m.m, '[^0-9]', '')) between 9 and 15", f"contains({plain}, '+')"),
        more("phone", LOCAL_PHONE, "[0-9]{3}-[0-9]{4}"),
        more("iban", IBAN, "[A-Z]{2}[0-9]{2}"),
        more("secret", SECRET, "(?i)token|secret|passw|key"),
    ]
    return df.withColumn(name, F.expr(f"if({plain} is not null, concat({', '.join(lists)}), {empty})")).drop(plain, dashed)


@dataclass(frozen=True)
class PiiModel:
    weights: tuple[float, ...]
    bias: float
    reliability: dict[str, float]  # share of a labeler's votes that agree with the estimated truth


def estimate(patterns: list[tuple[int, str, int]], rules: PiiRules) -> tuple[dict[tuple[int, str], float], dict[str, float]]:
    """Expectation-maximisation over (kind, votes, count): the probability of each pattern, the labelers' reliabilities."""
    names = ("checksum", "shape", "gazetteer", "context", "isolation", "variety")
    p = {(k, v): 1 / (1 + 3.0 ** (v.count("-") * 2 - v.count("+"))) for k, v, _ in patterns}
    for _ in range(rules.rounds):
        tables = [{(y, s): 1.0 for y in (0, 1) for s in "+0-"} for _ in range(LABELERS)]
        prior = {k: [1.0, 1.0] for k in range(len(KINDS))}
        for k, v, n in patterns:
            yes = p[k, v]
            prior[k][1] += n * yes
            prior[k][0] += n * (1 - yes)
            for table, s in zip(tables, v, strict=True):
                table[1, s] += n * yes
                table[0, s] += n * (1 - yes)
        for table in tables:
            for y in (0, 1):
                total = sum(table[y, s] for s in "+0-")
                for s in "+0-":
                    table[y, s] /= total
        for k, v, _ in patterns:
            odds = log(prior[k][1]) - log(prior[k][0]) + sum(log(t[1, s]) - log(t[0, s]) for t, s in zip(tables, v, strict=True))
            p[k, v] = 1 / (1 + 2.718281828459045 ** max(-60.0, min(60.0, -odds)))
    right = {}
    for j, name in enumerate(names):
        said = sum(n for _, v, n in patterns if v[j] != "0")
        right[name] = sum(n * (p[k, v] if v[j] == "+" else 1 - p[k, v]) for k, v, n in patterns if v[j] != "0") / said if said else 0.5
    return p, right


def fit(found: DataFrame, rules: PiiRules = PiiRules()) -> PiiModel:
    """Train on a table with the column ``spans`` of :func:`candidates`, over all its rows."""
    spark = found.sparkSession
    spans = staged(found.select(F.explode("spans").alias("s")).select("s.kn", "s.votes", "s.feats"), "pii-spans")
    patterns = sorted(map(tuple, spans.groupBy("kn", "votes").count().collect()))
    if not patterns:
        return PiiModel((0.0,) * rules.buckets, -1.0, {})
    p, right = estimate(patterns, rules)
    soft = spark.createDataFrame([(k, v, round(x * 1_000_000)) for (k, v), x in p.items()], "kn int, votes string, yes long")
    labelled = spans.join(F.broadcast(soft), ["kn", "votes"])  # at most 3 ** 6 patterns a kind
    sums = labelled.select("yes", F.explode(F.array_distinct("feats")).alias("f")).groupBy("f").agg(F.sum("yes").alias("yes"), F.count("*").alias("n")).collect()
    all_yes = sum(n * p[k, v] for k, v, n in patterns)
    all_no = sum(n for _, _, n in patterns) - all_yes
    a, weights = rules.smoothing, [0.0] * rules.buckets
    for f, yes, n in sums:
        yes = yes / 1_000_000
        weights[f] = round(log((yes + a) / (all_yes + 2 * a)) - log((n - yes + a) / (all_no + 2 * a)), 6)
    return PiiModel(tuple(weights), round(log((all_yes + a) / (all_no + a)), 6), right)


def decided(found: DataFrame, model: PiiModel, rules: PiiRules = PiiRules(), name: str = "spans") -> DataFrame:
    """``found`` with its candidates reduced to the base spans and the added ones that don't overlap them."""
    number = lambda x: f"double('{x!r}')"
    table = f"cast(split('{','.join(map(repr, model.weights))}', ',') as array<double>)"
    score = f"aggregate(array_distinct(s.feats), {number(model.bias)}, (a, f) -> a + get({table}, f))"
    wanted = f"filter({name}, s -> not s.base and not s.final and {score} >= {number(log(rules.accept / (1 - rules.accept)))})"
    kept, added = free_name(found, "base"), free_name(found, "added")
    df = found.withColumn(kept, F.expr(f"filter({name}, s -> s.base)")).withColumn(added, F.expr(wanted))
    form = lambda spans: f"transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kn', s.kn, 'base', s.base))"
    # An added span is free where the base spans before it have ended and the next begins behind it.
    ended = _running("transform(sp, s -> if(s.base, s.end, -1L))", "-1L", "greatest(a, x)")
    begins = f"reverse({_running(f'transform(reverse(sp), s -> if(s.base, s.start, {2**62}L))', f'{2**62}L', 'least(a, x)')})"
    free = _let(ended, "u", _let(begins, "w", "filter(sp, (s, i) -> s.base or (get(u, i) <= s.start and get(w, i) >= s.end))"))
    spans = f"if(size({added}) > 0, {_let(f'array_sort({form(f'concat({kept}, {added})')})', 'sp', free)}, {form(kept)})"
    back = f"array_sort(transform({spans}, s -> named_struct('kn', s.kn, 'start', s.start, 'end', s.end, 'base', s.base)))"
    return df.withColumn(name, F.expr(back)).drop(kept, added)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kn"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, rules: PiiRules = PiiRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of (kn, start, end, base), by kind, then place.

    ``kn`` is the place of the kind in ``KINDS``. Places count code points, ends
    are exclusive. Null text is empty and has no span; rows that share an id are
    read each for itself; an empty table gives an empty result; other columns are
    not read. Texts of any length and density are read whole, in time that grows
    little faster than their length.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = staged(candidates(named, rules).select("doc_id", "spans"), "pii-candidates")
    return decided(found, fit(found, rules), rules)


def redact(docs: DataFrame, rules: PiiRules = PiiRules(), text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<KIND>``; overlapping spans become one, named after the first.

    Null text stays null, an empty table stays empty, repeated rows are redacted alike
    and other columns are kept. Texts of any length take time in proportion to their
    length and spans. The texts are read twice: once to train, once to redact.
    """
    name = free_name(docs, "spans")
    found = staged(candidates(docs.select(text_col), rules, text_col, "spans").select("spans"), "pii-candidates")
    df = decided(candidates(docs, rules, text_col, name), fit(found, rules), rules, name)
    kinds = f"array({', '.join(_q(f'<{k.upper()}>') for k in KINDS)})"
    spans = f"array_sort(transform({name}, s -> named_struct('start', s.start, 'end', s.end, 'mark', get({kinds}, s.kn))))"
    text = free_name(docs, "whole")
    pieces = f"regexp_extract_all({text}, '(?s).{{1,{SEGMENT}}}', 0)"  # so that no part is counted off from the beginning of the text

    def between(a: str, b: str) -> str:
        first = f"cast(floor({a} / {SEGMENT}) as int)"
        some = f"array_join(slice(pieces, {first} + 1, cast(floor(({b} - 1) / {SEGMENT}) as int) - {first} + 1), '')"
        return f"if({a} < {b}, substring({some}, cast({a} - {first} * {SEGMENT} + 1 as int), cast({b} - {a} as int)), '')"

    ended = _running("transform(sp, s -> s.end)", "0L", "greatest(a, x)")
    marked = f"transform(sp, (s, i) -> if(get(ends, i) <= s.start, concat({between('get(ends, i)', 's.start')}, s.mark), ''))"
    rest = between("array_max(transform(sp, s -> s.end))", f"(cast(size(pieces) as bigint) * {SEGMENT})")
    new = _let(spans, "sp", _let(pieces, "pieces", _let(ended, "ends", f"concat(array_join({marked}, ''), {rest})")))
    df = df.withColumn(text, F.col(text_col))
    return df.withColumn(text_col, F.expr(f"if(size({name}) > 0, {new}, {text})")).drop(name, text)
