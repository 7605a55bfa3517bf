"""URL filters by a temporal list join. SQL functions only.

Dated list entries (a domain, a category, added or removed, and when) become
validity intervals. Every capture is judged by the entries that were active when it
was fetched: its host and the domains above it are joined to the intervals as of the
fetch time. The join runs over distinct (host, fetch time), and pages follow by an
equi-join, so copies and hot hosts cost no more than their keys.

Domains with many intervals are joined through dyadic pieces of time: an interval is
cut into aligned power-of-two pieces, a fetch time belongs to one piece per size, and
equal pieces meet. Nothing is compared with every interval of a busy domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import neighbour

#: Seconds are counted in 32 bits; times outside are brought to the nearest end.
BITS = 32
FOREVER = (1 << BITS) - 1
DAY = 86_400
LONGEST = 253  # characters a host name may have
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#@]+)(?:[/:?#]|$)"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, or null; what is longer than ``LONGEST`` characters is no host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(F.length(host).between(1, LONGEST), host)


def domains_of(host: Column) -> Column:
    """The host and the domains above it, to two labels; the host alone if it has one label."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, category, since, until) from entries (domain, category, at, listed); times are epoch seconds.

    An entry holds until the next one of its domain and category; the last holds
    forever. Of entries at the same second a listing wins. Entries with a null
    domain, category or time take no part; repeated entries count once.
    """
    at = F.least(F.greatest(F.col("at"), F.lit(0)), F.lit(FOREVER)).cast("long")
    known = entries.where("domain is not null and category is not null and at is not null").withColumn("at", at)
    known = known.groupBy(F.lower("domain").alias("domain"), "category", "at").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    spans = neighbour(known, ["domain", "category"], "at", True, DAY, "next")
    return spans.where("listed").select("domain", "category", F.col("at").alias("since"), F.coalesce("next", F.lit(FOREVER)).alias("until"))


def _pieces(since: Column, until: Column) -> Column:
    """The aligned power-of-two pieces (size, number) that make up [since, until).

    These are the pieces inside whose parents aren't; of one size only the first
    and the last inside can be that.
    """

    def edges(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        first, last = F.ceil(since / size).cast("long"), F.floor(until / size).cast("long") - 1
        both = F.array(F.struct(k.alias("k"), first.alias("p")), F.struct(k.alias("k"), last.alias("p")))
        return F.when(first <= last, both).otherwise(F.array().cast("array<struct<k:int,p:bigint>>"))

    def parent_inside(x: Column) -> Column:
        size, p = F.pow(F.lit(2.0), x["k"] + 1), F.floor(x["p"] / 2)
        return (p * size >= since) & ((p + 1) * size <= until)

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), edges))
    return F.array_distinct(F.filter(found, lambda x: ~parent_inside(x)))


def active(keys: DataFrame, spans: DataFrame, busy: int = 64) -> DataFrame:
    """(host, fetched_at, domain, category, since, until): the intervals that hold at each distinct (host, fetched_at)."""
    named = keys.where("host is not null and fetched_at is not null").withColumn("domain", F.explode(domains_of(F.col("host"))))
    counts = spans.groupBy("domain").count()
    often = counts.where(F.col("count") > busy).select("domain")
    few = spans.join(often, "domain", "left_anti")
    holds = (F.col("fetched_at") >= F.col("since")) & (F.col("fetched_at") < F.col("until"))
    plain = named.join(few, "domain").where(holds)
    cut = spans.join(often, "domain", "left_semi").withColumn("piece", F.explode(_pieces(F.col("since"), F.col("until"))))
    cut = cut.select("domain", "category", "since", "until", F.col("piece.k").alias("k"), F.col("piece.p").alias("p"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda k: F.struct(k.alias("k"), F.floor(F.col("fetched_at") / F.pow(F.lit(2.0), k)).cast("long").alias("p")))
    timed = named.join(often, "domain", "left_semi").withColumn("level", F.explode(levels))
    timed = timed.select("host", "fetched_at", "domain", F.col("level.k").alias("k"), F.col("level.p").alias("p"))
    dyadic = timed.join(cut, ["domain", "k", "p"])
    columns = ["host", "fetched_at", "domain", "category", "since", "until"]
    return plain.select(columns).unionByName(dyadic.select(columns))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``verdict``: struct(host, blocked, domain, category, since, until).

    ``at_col`` holds epoch seconds. The entry reported is the one of the longest
    domain, then of the first category by name. A null URL, a URL without a host (one of
    over 253 characters is none) or a null time is never blocked. Empty tables give
    empty results, and a long URL costs its own length. Repeated captures are judged alike and all stay; a
    column that is already called ``verdict`` is replaced.
    """
    captures = captures.drop("verdict")
    host, at = host_of(F.col(url_col)), F.least(F.greatest(F.col(at_col), F.lit(0)), F.lit(FOREVER - 1)).cast("long")
    keys = captures.select(host.alias("host"), at.alias("fetched_at")).distinct()
    found = active(keys, intervals(entries))
    rank = F.struct(-F.length("domain"), F.col("category"), F.col("since"))
    best = found.groupBy("host", "fetched_at").agg(F.min_by(F.struct("domain", "category", "since", "until"), rank).alias("hit"))
    best = best.select(F.col("host").alias("hit_host"), F.col("fetched_at").alias("hit_at"), "hit")
    joined = captures.join(best, (host == F.col("hit_host")) & (at == F.col("hit_at")), "left")
    verdict = F.struct(host.alias("host"), F.col("hit").isNotNull().alias("blocked"), F.col("hit.domain").alias("domain"), F.col("hit.category").alias("category"), F.col("hit.since").alias("since"), F.col("hit.until").alias("until"))
    return joined.withColumn("verdict", verdict).drop("hit_host", "hit_at", "hit")
