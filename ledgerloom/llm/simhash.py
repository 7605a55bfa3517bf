"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

Fingerprints of 64 bits are cut into ``r`` blocks. Two that differ in at most
``d`` bits agree on at least ``r - d`` blocks, so every choice of ``r - d``
blocks makes a key, and close pairs share one. ``r`` grows with the number of
distinct fingerprints (:func:`blocks_for`), which keeps the keys' groups small
without changing any link.

Exact copies have one fingerprint and are never paired. In groups of a key above
``hot`` members the pairs are not emitted: the group is cut into chunks, each
pair of chunks is a task of its own that compares them by numpy and returns the
edges of a spanning forest. Components are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, measured, small_batches, staged

BITS = 64
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text's shingles of ``size`` words; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = [xxh64_intdigest(line, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(set_bits * 2 > len(hashes), bitorder="little")
    return int.from_bytes(value.tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp", size: int = 4) -> DataFrame:
    """``docs`` with its fingerprints as signed 64-bit integers in column ``name``."""

    small_batches(docs.sparkSession)
    return docs.withColumn(name, _fp(F.col(text_col), size))


def _fp(text: Column, size: int) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))

    return of(text)


def blocks_for(n: int, distance: int = 4) -> int:
    """The fewest blocks whose keys have at least ``n`` values, so that chance groups hold about one member."""
    for r in range(distance + 2, 3 * distance + 1):
        if (r - distance) * (BITS // r) >= max(n, 2).bit_length():
            return r
    return 3 * distance


def block_keys(fp: Column, r: int, distance: int) -> Column:
    """The keys of a fingerprint: which blocks, and their bits."""
    widths = [BITS // r + (i < BITS % r) for i in range(r)]
    at = [sum(widths[:i]) for i in range(r)]
    blocks = [F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << widths[i]) - 1)) for i in range(r)]
    keys = []
    for which, chosen in enumerate(combinations(range(r), r - distance)):
        key = F.lit(which).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseXOR(blocks[i])
        keys.append(key)
    if sum(sorted(widths)[distance:]) + comb(r, distance).bit_length() > BITS:
        raise ValueError("keys don't fit 64 bits")
    return F.array(*keys)


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, distance: int = 4, hot: int = 64, chunk: int = 2048) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints which are linked, given distinct ``fp``.

    Not every linked pair has an edge of its own, but every one is joined by a path of edges.
    """
    n = fps.count()
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks_for(n, distance), distance)).alias("key"))
    groups = keyed.groupBy("key").count()
    busy = staged(groups.where(F.col("count") > hot), "simhash-hot")
    shared = keyed.join(busy, "key", "left_anti")
    a, b = shared.select("key", F.col("fp").alias("a")), shared.select("key", F.col("fp").alias("b"))
    near = a.join(b, "key").where((F.col("a") < F.col("b")) & (hamming("a", "b") <= distance)).select("a", "b").distinct()
    pieces = F.ceil(F.col("count") / chunk).cast("int")
    crowded = keyed.join(busy, "key").withColumn("pieces", pieces).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    crowded = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    crowded = crowded.select("key", "fp", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        left = group.loc[group["mine"] == group["i"], "fp"].to_numpy(np.int64)
        right = group.loc[group["mine"] == group["j"], "fp"].to_numpy(np.int64)
        return pd.DataFrame(spanning(left, None if group["i"].iat[0] == group["j"].iat[0] else right, distance), columns=["a", "b"])

    return near.unionByName(crowded.groupBy("key", "i", "j").applyInPandas(forest, "a long, b long"))


def spanning(left: np.ndarray, right: np.ndarray | None, distance: int, rows: int = 256) -> np.ndarray:
    """Edges of a spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    nodes = left if right is None else np.concatenate([left, right])
    bits = nodes.view(np.uint64)  # bitwise_count takes a signed number's absolute value
    side = np.zeros(len(nodes), bool)
    side[len(left) :] = True
    unseen = np.ones(len(nodes), bool)
    edges = []
    for root in range(len(nodes)):
        if not unseen[root]:
            continue
        unseen[root] = False
        front = np.array([root])
        while len(front):
            now, front = front[:rows], front[rows:]
            rest = np.flatnonzero(unseen)
            near = np.bitwise_count(bits[now][:, None] ^ bits[rest][None, :]) <= distance
            if right is not None:
                near &= side[now][:, None] != side[rest][None, :]
            found = rest[near.any(axis=0)]
            unseen[found] = False
            edges.append(np.column_stack([np.full(len(found), nodes[root]), nodes[found]]))
            front = np.concatenate([front, found])
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Alternating star contraction: neighbours above a node, then those below it,
    are hung on its smallest neighbour, until nothing changes. Each round is
    written to the shared folder. Only minima by node are aggregated, and the
    joins may split hot nodes.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = staged(large, "components")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        now = staged(small.where("a <> b").distinct(), "components")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("star contraction did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def classes(by_doc: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root, component_id) for the fingerprints in ``by_doc`` (doc_id, fp)."""
    fps = staged(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    return rooted_classes(fps, links(fps.select("fp"), distance))


def rooted_classes(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id) from distinct fingerprints (fp, first_id) and the edges (a, b) between them.

    Only linked fingerprints meet their component's row, which is broadcast where the components are few.
    """
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = staged(fps.select("fp", "first_id").join(roots, "fp", "left"), "simhash-rooted")
    lone = rooted.where("root is null").select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"))
    linked = rooted.where("root is not null")
    least = staged(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    return lone.unionByName(linked.join(measured(least), "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, distance: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Null text has no words; texts without words have fingerprint zero, which is
    linked like any other. ``component_id`` is the smallest doc_id that can be
    reached over links; null ids are ignored there unless all are null. Rows that
    share an id stay rows. Texts of any length are read whole. An empty table gives
    an empty result; other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    by_doc = staged(with_fingerprint(named, size=size).select("doc_id", "fp"), "simhash-fingerprints")
    return by_doc.join(classes(by_doc, distance), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the row of the smallest id stays, as :func:`keep_rows` has it."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    by_doc = staged(with_fingerprint(named, size=size).select("doc_id", "fp"), "simhash-fingerprints")
    return keep_rows(docs, by_doc, classes(by_doc, distance), lambda text: _fp(text, size), id_col, text_col)


def keep_rows(docs: DataFrame, by_doc: DataFrame, classed: DataFrame, fp_of: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one of the smallest id.

    ``by_doc``: (doc_id, fp) of every row; ``classed``: (fp, root, component_id);
    ``fp_of`` computes a text's ``fp``. Of rows that share an id and lie in one
    component those of the smallest ``fp`` count, and of these the one with the
    smallest text, then the smallest hash of all its columns. Where all ids of a
    component are null, one row stays. Repeated rows stay once.

    Only ids and fingerprints are shuffled: texts meet the ids to drop, which are
    broadcast where they are few. Rows with a null or repeated id are looked up by id
    and fingerprint instead.
    """
    odd = staged(by_doc.groupBy("doc_id").count().where("doc_id is null or count > 1").select(F.col("doc_id").alias("odd_id")), "simhash-odd")
    is_odd = lambda df, c: df.join(measured(odd), F.col(c).eqNullSafe(F.col("odd_id")), "left_semi")
    placed = by_doc.join(classed, "fp")
    drop = staged(placed.where("doc_id is not null and not doc_id <=> component_id").select(F.col("doc_id").alias("drop_id")), "simhash-drop")
    once = docs.join(measured(drop), F.col(id_col) == F.col("drop_id"), "left_anti")
    if odd.isEmpty():
        return once
    once = once.join(measured(odd), F.col(id_col).eqNullSafe(F.col("odd_id")), "left_anti")
    chosen = is_odd(placed.where("doc_id <=> component_id"), "doc_id").groupBy("root", "component_id", "doc_id").agg(F.min("fp").alias("fp"))
    chosen = staged(chosen.select(F.col("doc_id").alias("chosen_id"), F.col("fp").alias("chosen_fp")).distinct(), "simhash-chosen")
    fp = free_name(docs, "fp")
    marked = is_odd(docs, id_col).withColumn(fp, fp_of(F.col(text_col)))
    marked = marked.join(measured(chosen), (F.col(fp) == F.col("chosen_fp")) & F.col(id_col).eqNullSafe(F.col("chosen_id")), "left_semi")
    row = F.struct(*docs.columns)
    first = marked.groupBy(id_col, fp).agg(F.min_by(row, F.struct(F.col(text_col), F.xxhash64(*docs.columns))).alias(fp + "_row"))
    return once.unionByName(first.select(fp + "_row.*"))
