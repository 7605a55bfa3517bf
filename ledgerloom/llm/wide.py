"""SimHash for texts that share 0.8 of their shingles: a wide fingerprint, pigeonhole blocks, Hamming distance, then the sets.

The 64 bits of :mod:`simhash` link copies that differ in a few bits. Sets of Jaccard
similarity ``s`` have a cosine of at least ``2 s / (1 + s)``, so at 0.8 each bit of a
fingerprint agrees with a chance of 0.85 and some ten bits of 64 differ. The
fingerprint here is therefore as wide as it takes: it is cut into blocks, pairs that
share a block are compared by the Hamming distance of 128 of their bits, and what is
close is measured on the shingle sets themselves, so no other text is linked. Blocks
grow with the logarithm of the table, their number follows from the chance ``MISS``
that a pair of just 0.8 shares none (:func:`blocks_for`).

Texts of one shingle set are one node. Two blocks together are shared by many texts
only in families of related texts, whose pairs would grow with the square of their
number. No pair inside a family is emitted: a family is cut into chunks, every two
chunks are a task that gets their sets and returns the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import measured, release, released, small_batches, staged
from ledgerloom.llm.simhash import LOWER, SEED, components, hamming, keep_rows, rooted_classes

SIZE = 5
LEAST = 0.8
MISS = 1e-4
#: Members of a group of two blocks that make it part of a family; chance brings less than one.
CROWD = 16
#: Shingles in a chunk of a family, and in one side of a block of pairs.
CHUNK = 2_000_000
SIDE = 2_000_000
#: Members of a block's group up to which all of its pairs are compared.
HOT = 2048
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
IS_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
_powers: tuple[np.ndarray, np.ndarray] | None = None
#: One odd factor for each word of the fingerprint.
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def agreement(least: float = LEAST) -> float:
    """The chance that a bit agrees in two sets of Jaccard similarity ``least``, sizes being equal; else it is higher."""
    return 1 - acos(2 * least / (1 + least)) / pi


def blocks_for(n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """(bits of a block, number of blocks) for ``n`` texts: a group holds some two hundred members by chance."""
    width = max(6, max(n, 2).bit_length() - 8)
    return width, ceil(log(miss) / log(1 - agreement(least) ** width))


def reach(least: float = LEAST, sigmas: float = 3.7) -> int:
    """The bits of 128 in which a pair of similarity ``least`` differs at most, but for a chance of one in ten thousand."""
    p = agreement(least)
    return int(128 * (1 - p) + sigmas * sqrt(128 * p * (1 - p)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse for the first ``n`` numbers, whole numbers modulo 2 ** 64."""
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (BASE, np.uint64(pow(int(BASE), -1, 2**64))))
    return up, down


def word_hashes(text: str | None, segment: int = 1 << 16) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased: polynomials over a word's bytes, from running sums over ``segment`` bytes or one word."""
    global _powers
    data = np.frombuffer((text or "").encode().translate(LOWER), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    found, at = [np.empty(0, np.uint64)], 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + segment, side="right")))
        first = starts[at]
        part = data[first : ends[upto - 1]].astype(np.uint64)
        if _powers is None or len(part) > len(_powers[0]):
            _powers = powers(max(len(part), segment))
        up, down = _powers
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        a, z = starts[at:upto] - first, ends[at:upto] - first
        x = (sums[z] - sums[a]) * down[a]
        x ^= x >> np.uint64(32)
        x *= MIX
        x ^= x >> np.uint64(29)
        found.append(x)
        at = upto
    return found[-1] if len(found) == 2 else np.concatenate(found)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; one of the whole text where it has fewer words than ``size``, none without words."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    k = min(size, len(hashes))
    n = len(hashes) - k + 1
    found = np.full(n, k, np.uint64)
    for i in range(k):
        found *= BASE
        found += hashes[i : i + n]
    found.sort()
    first = np.ones(n, bool)
    np.not_equal(found[1:], found[:-1], out=first[1:])
    return found[first]


def set_hash(grams: np.ndarray) -> int:
    """A signed hash of a shingle set; zero for the empty set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(grams.tobytes(), SEED)).astype(np.int64)) if len(grams) else 0


def bits_of(grams: np.ndarray, words: int) -> np.ndarray:
    """``64 * words`` SimHash bits of a shingle set: a bit is set where over half of the shingles' hashes have it."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(grams), 255):  # sums of 255 bits fit a byte
        x = grams[at : at + 255, None] * FACTORS[None, :words]
        x ^= x >> np.uint64(32)
        x *= MIX
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return ones * 2 > len(grams)


def blocks_of(bits: np.ndarray, width: int, number: int) -> np.ndarray:
    """The first ``number`` blocks of ``width`` bits, each with its own place in the key."""
    values = bits[: width * number].reshape(number, width) @ (1 << np.arange(width))
    return (np.arange(number) << width) + values


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit numbers as an Arrow list column."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.LargeListArray.from_arrays(ends, np.concatenate(arrays).view(np.int64)).cast(pa.list_(pa.int64())) if arrays else pa.array([], pa.list_(pa.int64()))


def sketches(docs: DataFrame, size: int, width: int, number: int) -> DataFrame:
    """(doc_id, fp, n, bits, more, blocks) of ``docs`` (doc_id, text): set hash, size, 128 bits and the blocks of the fingerprint."""
    words = ceil(max(width * number, 128) / 64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            sets = [shingles(text, size) for text in batch.column(1).to_pylist()]
            bits = [bits_of(grams, words) for grams in sets]
            heads = np.array([np.packbits(b[:128], bitorder="little").view("<i8") for b in bits], np.int64).reshape(-1, 2)
            blocks = [blocks_of(b, width, number) if len(grams) else none for grams, b in zip(sets, bits, strict=True)]
            plain = [pa.array(list(map(set_hash, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(heads[:, 0]), pa.array(heads[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *plain, lists_of(blocks)], names=["doc_id", "fp", "n", "bits", "more", "blocks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(released(of), f"doc_id {kind}, fp long, n int, bits long, more long, blocks array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int, name: str) -> DataFrame:
    """(fp, grams) of the ``nodes`` (fp, first_id), from one text of each; only texts of these ids are read into sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(set_hash, sets)), pa.int64()), lists_of(sets)], names=["fp", "grams"])

    wanted = measured(staged(nodes.select(F.col("first_id").alias("wanted")).distinct(), f"{name}-ids"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = texts.select("text").mapInArrow(released(of), "fp long, grams array<long>").join(nodes.select("fp"), "fp", "left_semi")
    return staged(sets.groupBy("fp").agg(F.first("grams").alias("grams")), f"{name}-sets")


def forest(nodes: np.ndarray, heads: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, least: float = LEAST) -> np.ndarray:
    """Edges of a spanning forest of the links among ``nodes``, or only of those between the two sides.

    ``heads`` are the nodes' 128 bits; their sets aren't empty.
    """
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.split(codes, np.cumsum(sizes)[:-1])
    bits = heads.view(np.uint64)  # bitwise_count takes a signed number's absolute value
    has = np.zeros(len(values), np.int32)
    live = np.arange(len(nodes))  # not reached yet
    front, edges = [], []
    while len(live):
        if not front:
            front.append(int(live[0]))
            live = live[1:]
        now = front.pop()
        near = np.bitwise_count(bits[live] ^ bits[now]).sum(axis=1) <= reach(least)
        near &= np.minimum(sizes[live], sizes[now]) >= least * np.maximum(sizes[live], sizes[now])
        if side is not None:
            near &= side[live] != side[now]
        maybe = np.flatnonzero(near)
        if not len(maybe):
            continue
        others = live[maybe]
        has[cut[now]] = 1
        common = np.add.reduceat(has[np.concatenate([cut[i] for i in others])], np.cumsum(sizes[others]) - sizes[others])
        has[cut[now]] = 0
        good = common / (sizes[others] + sizes[now] - common) >= least
        found = others[good]
        edges.append(np.column_stack([np.full(len(found), nodes[now]), nodes[found]]))
        front.extend(found.tolist())
        live = np.delete(live, maybe[good])
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def alike(a: np.ndarray, b: np.ndarray, sets: dict[int, np.ndarray], least: float = LEAST) -> np.ndarray:
    """Which of the pairs (a, b) have sets of similarity ``least`` or more."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    names = list(sets)
    place = {x: i for i, x in enumerate(names)}
    sizes = np.array([len(sets[x]) for x in names])
    _, codes = np.unique(np.concatenate([sets[x] for x in names]), return_inverse=True)
    ends = np.cumsum(sizes)
    cut = [codes[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    has = np.zeros(int(codes.max()) + 1, np.int32)
    good = np.zeros(len(a), bool)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
        mine = cut[place[a[lo]]]
        others = [place[x] for x in b[lo:hi].tolist()]
        has[mine] = 1
        n = sizes[others]
        common = np.add.reduceat(has[np.concatenate([cut[i] for i in others])], np.cumsum(n) - n)
        has[mine] = 0
        good[lo:hi] = common / (n + len(mine) - common) >= least
    found = np.zeros(len(a), bool)
    found[order] = good
    return found


def families(nodes: DataFrame, crowd: int) -> DataFrame:
    """(fp, root) of the nodes that share two neighbouring blocks with over ``crowd`` others, followed from group to group."""
    two = F.transform(F.sequence(F.lit(1), F.size("blocks") - 1, F.lit(2)), lambda i: F.xxhash64(F.get("blocks", i - 1), F.get("blocks", i)))
    keyed = nodes.where("n > 0").select("fp", F.explode(two).alias("key"))
    busy = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("fp").alias("head")).where(F.col("members") > crowd)
    busy = measured(staged(busy.select("key", "head"), "wide-busy"))
    return components(keyed.join(busy, "key").select(F.col("fp").alias("a"), F.col("head").alias("b"))).withColumnRenamed("node", "fp")


def family_links(docs: DataFrame, rooted: DataFrame, least: float, size: int, chunk: int) -> DataFrame:
    """(a, b): edges that connect exactly the members of each family which are linked."""
    members = staged(rooted.where("root is not null").select("fp", "first_id", "n", "bits", "more", "root"), "wide-members")
    sets = sets_of(docs, members.select("fp", "first_id"), size, "wide-family")
    weights = measured(staged(members.groupBy("root").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("pieces")), "wide-weights"))
    dealt = members.join(weights, "root").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("root", "fp", "bits", "more", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(sets, "fp")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        heads = np.ascontiguousarray(group[["bits", "more"]].to_numpy(np.int64))
        side = None if group["i"].iat[0] == group["j"].iat[0] else (group["mine"] == group["j"]).to_numpy()
        edges = pd.DataFrame(forest(group["fp"].to_numpy(np.int64), heads, group["grams"].tolist(), side, least), columns=["a", "b"])
        release()
        return edges

    return staged(dealt.groupBy("root", "i", "j").applyInPandas(links, "a long, b long"), "wide-family-links")


def close_pairs(nodes: DataFrame, least: float, hot: int) -> DataFrame:
    """(a, b): pairs that share a block but no family, differ in few of 128 bits and aren't too unequal in size.

    ``root`` is the family, null for nodes without one. In groups of over ``hot`` members those of the most frequent root are not paired with each other.
    """
    columns = ("fp", "n", "bits", "more", "root")
    keyed = nodes.select(*columns, F.explode("blocks").alias("key"))
    busy = staged(keyed.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > hot).select("key"), "wide-hot")
    few = measured(busy)
    side = lambda df, x: df.select("key", *[F.col(c).alias(f"{x}_{c}") for c in columns])
    root = lambda x: F.coalesce(f"{x}_root", f"{x}_fp")
    close = (root("a") != root("b")) & (hamming("a_bits", "b_bits") + hamming("a_more", "b_more") <= reach(least)) & (F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n"))
    plain = keyed.join(few, "key", "left_anti")
    found = side(plain, "a").join(side(plain, "b"), "key").where((F.col("a_fp") < F.col("b_fp")) & close).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    crowded = keyed.join(few, "key")
    crowded = crowded.withColumn("root", F.coalesce("root", "fp"))
    main = crowded.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    crowded = crowded.join(measured(staged(main, "wide-main")), "key")
    rare = crowded.where("root <> main")
    pairs = side(rare, "a").join(side(crowded, "b").join(measured(main), "key"), "key").where(((F.col("b_root") == F.col("main")) | (F.col("a_fp") < F.col("b_fp"))) & close)
    return found.unionByName(pairs.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b"))).distinct()


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float, size: int, side: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have a similarity of ``least`` or more.

    Nodes are dealt into parts of about ``side`` shingles; the pairs of two parts are
    one task, which gets each of its sets once.
    """
    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "wide-ends")
    suspects = staged(nodes.select("fp", "first_id", "n").join(ends, "fp", "left_semi"), "wide-suspects")
    parts = max(1, ceil((suspects.agg(F.sum("n")).first()[0] or 0) / side))
    sets = sets_of(docs, suspects, size, "wide-pair")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    dealt = pairs.withColumn("i", F.least(part("a"), part("b"))).withColumn("j", F.greatest(part("a"), part("b")))
    needed = dealt.select(F.col("i").alias("set_i"), F.col("j").alias("set_j"), F.explode(F.array("a", "b")).alias("fp")).distinct().join(sets, "fp")

    def check(some: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(some):
            return some[["a", "b"]]
        known = dict(zip(group["fp"].tolist(), group["grams"].tolist(), strict=True))
        good = alike(some["a"].to_numpy(np.int64), some["b"].to_numpy(np.int64), known, least)
        del known
        release()
        return some.loc[good, ["a", "b"]]

    return dealt.groupBy("i", "j").cogroup(needed.groupBy("set_i", "set_j")).applyInPandas(check, "a long, b long")


def classes(docs: DataFrame, by_doc: DataFrame, least: float, size: int, crowd: int, chunk: int, hot: int, side: int) -> DataFrame:
    """(fp, root, component_id) for the sketches ``by_doc`` of ``docs`` (doc_id, text)."""
    nodes = by_doc.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "bits", "more", "blocks")])
    nodes = staged(nodes, "wide-nodes")
    rooted = staged(nodes.join(families(nodes, crowd), "fp", "left"), "wide-rooted")
    near = family_links(docs, rooted, least, size, chunk)
    pairs = staged(close_pairs(rooted, least, hot), "wide-pairs")
    return rooted_classes(nodes.select("fp", "first_id"), near.unionByName(verified(docs, nodes, pairs, least, size, side)))


def near_duplicates(docs: DataFrame, least: float = LEAST, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS, crowd: int = CROWD, chunk: int = CHUNK, hot: int = HOT, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row of ``docs``, and (fp, root, component_id) of every shingle set.

    Texts are linked where they share ``least`` of their shingles of ``size`` words, A-Z
    lower-cased; links are followed from text to text. ``component_id`` is the smallest
    doc_id that can be reached. Texts without words, null among them, are copies of
    each other, and a text shorter than a shingle is one shingle. ``crowd``, ``chunk``,
    ``hot`` and ``side`` change the plan, not the result. An empty table gives empty results.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n = named.count()
    width, number = blocks_for(n, least, miss)
    found = staged(sketches(named, size, width, number), "wide-sketches")
    return found.select("doc_id", "fp"), classes(named, found, least, size, crowd, chunk, hot, side)


def keep_one(docs: DataFrame, least: float = LEAST, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", **plan: int) -> DataFrame:
    """``docs`` without near duplicates: of texts linked by a similarity of ``least`` or more the row of the smallest id stays.

    Links are those of :func:`near_duplicates`. Ids, repeated rows and other columns
    are treated as in :func:`simhash.keep_rows`.
    """
    by_doc, classed = near_duplicates(docs, least, size, id_col, text_col, **plan)
    return keep_rows(docs, by_doc, classed, lambda text: _fp(text, size), id_col, text_col)


def _fp(text: Column, size: int) -> Column:
    @F.pandas_udf("long")
    @released
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([set_hash(shingles(t, size)) for t in texts], dtype="int64")

    return of(text)
