"""Licence scans: an Aho-Corasick automaton finds notices, a shunting-yard parser reads expressions.

A text becomes its words (letters, digits and everything beyond ASCII, A-Z
lower-cased) joined by single spaces; the automaton holds every phrase with a
space on both sides, so it reports whole words only and all of them in one pass.
Behind an identifier tag the raw characters up to the end of the line are read as
a licence expression (``and``, ``or``, ``with``, brackets), which is evaluated
against what each licence permits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches

#: The phrases and labels every scan has, and those the method adds.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "unlicense": "unlicense",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "proprietary and confidential": "proprietary",
}
TAG_PHRASES = ("spdx license identifier",)
#: How freely a text under each label may be reused, 0 to 1.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1,
    "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.05, "proprietary": 0.0,
}
UNKNOWN = 0.5

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
LEXEME = re.compile(r"[()]|[A-Za-z0-9.+-]+")
BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of a licence identifier: ``Apache-2.0`` is ``apache``, ``CC-BY-NC-4.0`` is ``cc-by-nc``."""
    name = identifier.lower().rstrip("+")
    for suffix in ("-or-later", "-only"):
        name = name.removesuffix(suffix)
    name = re.sub(r"-[0-9][0-9.]*(-clause)?$", "", name)
    return {"cc0": "cc0", "bsd-2": "bsd", "bsd-3": "bsd"}.get(name, name)


@dataclass
class Expression:
    """A parsed licence expression: its labels in order of appearance and the freedom it grants."""

    labels: list[str] = field(default_factory=list)
    freedom: float = UNKNOWN
    valid: bool = False


def parse_expression(text: str) -> Expression:
    """Shunting-yard: operators wait on a stack until one that binds less tightly comes.

    ``and`` grants what both sides grant (the smaller freedom), ``or`` lets the
    reader choose (the larger), ``with`` is an exception that frees copyleft code
    to at least 0.6. Reading stops where an operator is missing (plain prose behind
    the expression); an expression that ends in an operator or has brackets that
    don't match is invalid and grants ``UNKNOWN``.
    """
    out: list[tuple[float, str]] = []
    ops: list[str] = []
    labels: list[str] = []

    def apply() -> bool:
        op = ops.pop()
        if op == "(" or len(out) < 2:
            return False
        (right, _), (left, name) = out.pop(), out.pop()
        out.append((min(left, right) if op == "and" else max(left, right) if op == "or" else max(left, 0.6), name))
        return True

    operand_next = True
    for token in LEXEME.findall(text):
        low = token.lower()
        if operand_next:
            if token == "(":
                ops.append(token)
            elif token == ")" or low in BINDS:
                return Expression(labels)
            else:
                if ops and ops[-1] == "with":
                    out.append((1.0, low))
                else:
                    label = label_of(token)
                    labels.append(label)
                    out.append((FREEDOM.get(label, UNKNOWN), label))
                operand_next = False
        elif token == ")":
            while ops and ops[-1] != "(":
                if not apply():
                    return Expression(labels)
            if not ops:
                break
            ops.pop()
        elif low in BINDS:
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[low]:
                if not apply():
                    return Expression(labels)
            ops.append(low)
            operand_next = True
        else:
            break
    if operand_next:
        return Expression(labels)
    while ops:
        if not apply():
            return Expression(labels)
    return Expression(labels, out[0][0], True) if len(out) == 1 else Expression(labels)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", dict.fromkeys(TAG_PHRASES, ""))):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, phrase, label))
    found.make_automaton()
    return found


def scan_text(text: str, machine) -> tuple[int, list[tuple[str, str, str, int]], list[Expression]]:
    """(number of words, [(kind, phrase, label, place of its first word)], expressions)."""
    lowered = text.translate(UPPER)
    words = WORDS.findall(lowered)
    line = f" {' '.join(words)} "
    found, place, at = [], 0, 0
    for end, (kind, phrase, label) in machine.iter(line):
        start = end - len(phrase) - 1
        if start >= at:
            place += line.count(" ", at, start)
            at, here = start, place
        else:
            here = place - line.count(" ", start, at)
        found.append((kind, phrase, label, here))
    tagged = [parse_expression(m[1]) for m in TAG.finditer(lowered)] if any(f[0] == "tag" for f in found) else []
    return len(words), found, tagged


FINDING = "struct<kind:string,phrase:string,label:string,word:bigint>"
SCAN = f"n_words long, findings array<{FINDING}>, tag_labels array<string>, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, findings (kind, phrase, label, word), tag_labels, score for every row.

    ``score`` is the freedom that all findings grant together: the least over
    notices and tagged expressions, 1 for none but free licences, 0.5 where
    nothing is found or nothing found is known. A notice whose words lie inside a
    longer one (``cc by`` in ``cc by nc``) counts as the longer only, base phrases
    always count. Null text is empty; texts of any length are read whole; rows with
    the same doc_id are scanned each for itself; an empty table gives an empty
    result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        item = pa.struct([("kind", pa.string()), ("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64())])
        for batch in batches:
            n_words, findings, tags, scores = [], [], [], []
            for value in batch.column(1):
                n, found, expressions = scan_text(value.as_py() or "", machine)
                found = longest(found)
                known = [FREEDOM[f[2]] for f in found if f[2] in FREEDOM]
                known += [e.freedom for e in expressions]
                n_words.append(n)
                findings.append([dict(zip(("kind", "phrase", "label", "word"), f, strict=True)) for f in found])
                tags.append(sorted({label for e in expressions for label in e.labels}))
                scores.append(min(known, default=UNKNOWN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(findings, pa.list_(item)), pa.array(tags, pa.list_(pa.string())), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "findings", "tag_labels", "score"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, {SCAN}")


def longest(found: list[tuple[str, str, str, int]], near: int = 25) -> list[tuple[str, str, str, int]]:
    """Without the added notices that lie wholly inside another finding.

    Findings come by the place where they end, and no phrase has over five words,
    so one that holds another is among its ``near`` neighbours.
    """
    spans = [(f[3], f[3] + f[1].count(" ") + 1) for f in found]
    kept = []
    for i, (f, (a, b)) in enumerate(zip(found, spans, strict=True)):
        around = spans[max(0, i - near) : i + near + 1] if f[0] == "notice" else []
        if not any(c <= a and b <= d and d - c > b - a for c, d in around):
            kept.append(f)
    return kept
