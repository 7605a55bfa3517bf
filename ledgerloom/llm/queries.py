"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import clustering, licences, mixing, packing, pii, quality, quotes, simhash, tokenfile, topk, toxicity, urllists, whitening
from ledgerloom.llm.common import documents, shared_dir


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' conversations quote nothing, so every second message gets the one before as a quotation, wrapped anew, and some of these the one before that, a level deeper."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    earlier = lambda k, x: c.groupBy("conv_id", (F.col("turn") + k).alias("turn")).agg(F.min("text").alias(x))
    wrapped = lambda x, mark: F.concat(F.lit(mark), F.regexp_replace(F.regexp_replace(x, "\n", "\n" + mark), "((?:[^ \n>]+ ){6})", "$1\n" + mark))
    df = c.join(earlier(1, "a"), ["conv_id", "turn"], "left").join(earlier(2, "b"), ["conv_id", "turn"], "left")
    deep = F.when((F.col("turn") % 4 == 3) & F.col("b").isNotNull(), F.concat(wrapped("b", ">> "), F.lit("\n"))).otherwise("")
    quoting = F.concat(F.lit("On Monday they wrote:\n"), deep, wrapped("a", "> "), F.lit("\n"), F.coalesce("text", F.lit("")))
    return quotes.link(df.withColumn("text", F.when((F.col("turn") % 2 == 1) & F.col("a").isNotNull(), quoting).otherwise(F.col("text"))))


OP1_SQL = r"""
WITH e AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
c AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN c.turn % 2 = 1 AND a.text IS NOT NULL THEN 'On Monday they wrote:' || chr(10)
    || CASE WHEN c.turn % 4 = 3 AND b.text IS NOT NULL THEN '>> ' || regexp_replace(replace(b.text, chr(10), chr(10) || '>> '), '((?:[^ \n>]+ ){6})', '\1' || chr(10) || '>> ', 'g') || chr(10) ELSE '' END
    || '> ' || regexp_replace(replace(a.text, chr(10), chr(10) || '> '), '((?:[^ \n>]+ ){6})', '\1' || chr(10) || '> ', 'g') || chr(10) || coalesce(c.text, '') ELSE c.text END AS text
  FROM conversations c LEFT JOIN e a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN e b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
l0 AS (
  SELECT conv_id, turn, i, line, len(regexp_replace(regexp_extract(line, '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(translate(regexp_replace(line, '^(?:[ \t]{0,3}>)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\x01-\x03]+', ' ', 'g')) AS norm
  FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM c)),
l AS (
  SELECT conv_id, turn, i, line, norm, CASE WHEN level = 0 AND bool_or(level > 0 AND norm <> '') OVER (PARTITION BY conv_id, turn)
    AND regexp_matches(line, '(?i)^[ \t]*(?:on .{1,200} wrote|am .{1,200} schrieb .{0,100}|le .{1,200} a écrit|el .{1,200} escribió)[ \t]?:[ \t\r]*$') THEN -1 ELSE level END AS level FROM l0),
r AS (SELECT *, CASE WHEN level <> lag(level) OVER w OR lag(norm) OVER w = '' THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
p AS (
  SELECT conv_id, turn, level, k, string_agg(norm, ' ' ORDER BY i) AS passage
  FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM r) WHERE norm <> '' GROUP BY ALL),
s AS (SELECT conv_id, turn, level, unnest(string_split(regexp_replace(passage, '([.!?]) ', '\1' || chr(3), 'g'), chr(3))) AS sentence FROM p),
m AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quoted, greatest(coalesce(max(level), 0), 0) AS max_level FROM s GROUP BY ALL),
said AS (SELECT DISTINCT conv_id, turn, sentence FROM s WHERE level = 0),
votes AS (
  SELECT conv_id, turn, level, origin, count(*) AS n FROM (
    SELECT q.conv_id, q.turn, q.level, (SELECT max(o.turn) FROM said o WHERE o.conv_id = q.conv_id AND o.sentence = q.sentence AND o.turn < q.turn) AS origin FROM s q WHERE q.level > 0)
  WHERE origin IS NOT NULL GROUP BY ALL),
a AS (SELECT conv_id, turn, arg_max(origin, (-level, n, origin)) AS answered, CAST(sum(n) AS BIGINT) AS n_linked FROM votes GROUP BY ALL),
b AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
own AS (SELECT conv_id, turn, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^(?:[ \t\r]*\n)+', ''), '\s+$', '') AS own FROM l WHERE level = 0 GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, coalesce(answered, previous) AS reply_to,
       coalesce(lpad(CAST(coalesce(answered, previous) + 1000000000000000000 AS VARCHAR), 19, '0'), repeat('0', 19)) || '.' || lpad(CAST(c.turn + 1000000000000000000 AS VARCHAR), 19, '0') AS reply_order,
       coalesce(n_quoted, 0) AS n_quoted, CAST(coalesce(max_level, 0) AS BIGINT) AS max_level, coalesce(n_linked, 0) AS n_linked, coalesce(own, '') AS own
FROM conversations c JOIN b USING (conv_id, turn) LEFT JOIN m USING (conv_id, turn)
LEFT JOIN a USING (conv_id, turn) LEFT JOIN own USING (conv_id, turn)
"""


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_urllists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold neither fetch times nor a list, so both follow from page ids.

    A page is fetched at a second of 2024 or 2025; three of four domains are listed
    from some day on, taken off the list again, and a third of them listed anew.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", (F.lit(START) + F.pmod(F.col("page_id") * 7919, F.lit(731)) * urllists.DAY + F.pmod(F.col("page_id") * 31, F.lit(urllists.DAY))).alias("fetched_at"))
    domain = F.regexp_replace(urllists.host_of(F.col("url")), r"^(?:www|blog|m)\.", "")
    listed = pages.select(domain.alias("domain"), "page_id").where("domain is not null").groupBy("domain").agg(F.min("page_id").alias("x")).where("x % 4 <> 0")
    category = F.get(F.array(F.lit("malware"), F.lit("spam"), F.lit("adult")), (F.col("x") % 3).cast("int"))
    day = lambda d: (F.lit(START) + d * urllists.DAY).cast("long")
    first = F.col("x") % 300
    steps = F.array(
        F.struct(day(first).alias("at"), F.lit(True).alias("listed")),
        F.struct(day(first + 30 + F.col("x") % 97).alias("at"), F.lit(False).alias("listed")),
        F.struct(day(first + 200 + F.col("x") % 50).alias("at"), (F.col("x") % 3 == 0).alias("listed")),
    )
    entries = listed.select("domain", category.alias("category"), F.explode(steps).alias("s")).select("domain", "category", "s.at", "s.listed")
    judged = urllists.judge(captures, entries)
    return judged.select("page_id", "url", "fetched_at", "verdict.host", "verdict.blocked", "verdict.domain", "verdict.category", "verdict.since", "verdict.until")


START = 1_704_067_200  # 2024-01-01

OP4_SQL = r"""
WITH c AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 731 * 86400 + (page_id * 31) % 86400 AS fetched_at,
         CASE WHEN length(name) BETWEEN 1 AND 253 THEN name END AS host
  FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#@]+)(?:[/:?#]|$)', 1)), '\.$', '') AS name FROM pages)),
x AS (SELECT regexp_replace(host, '^(?:www|blog|m)\.', '') AS domain, min(page_id) AS x FROM c WHERE host IS NOT NULL GROUP BY 1 HAVING min(page_id) % 4 <> 0),
e AS (
  SELECT domain, ['malware', 'spam', 'adult'][1 + x % 3] AS category, 1704067200 + (x % 300) * 86400 AS since, 1704067200 + (x % 300 + 30 + x % 97) * 86400 AS until FROM x
  UNION ALL
  SELECT domain, 'malware', 1704067200 + (x % 300 + 200 + x % 50) * 86400, 4294967295 FROM x WHERE x % 3 = 0),
h AS (
  SELECT c.host, c.fetched_at, e.*, row_number() OVER (PARTITION BY c.host, c.fetched_at ORDER BY len(e.domain) DESC, e.category, e.since) AS r
  FROM (SELECT DISTINCT host, fetched_at FROM c) c JOIN e ON (c.host = e.domain OR ends_with(c.host, '.' || e.domain)) AND c.fetched_at >= e.since AND c.fetched_at < e.until)
SELECT c.page_id, c.url, c.fetched_at, c.host, h.domain IS NOT NULL AS blocked, h.domain, h.category, h.since, h.until
FROM c LEFT JOIN h ON c.host = h.host AND c.fetched_at = h.fetched_at AND h.r = 1
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s0),
t0 AS (SELECT 1.5::DOUBLE * sum(size) AS budget FROM d),
lv AS (
  SELECT 0 AS i, 0.0::DOUBLE AS level
  UNION ALL
  SELECT i + 1, ((SELECT budget FROM t0) - (SELECT coalesce(sum(2.0::DOUBLE * source_size), 0) FROM s WHERE w * level > 2.0::DOUBLE * source_size))
              / (SELECT sum(w) FROM s WHERE NOT (w * level > 2.0::DOUBLE * source_size))
  FROM lv WHERE i < 40),
tg AS (SELECT s.source, source_size, least(w * (SELECT max(level) FROM lv), 2.0::DOUBLE * source_size) AS target FROM s),
tw AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM tg),
tn AS (SELECT *, target - whole * source_size AS need FROM tw),
c AS (
  SELECT d.source, h, need, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) AS words
  FROM d JOIN tn ON d.source IS NOT DISTINCT FROM tn.source WHERE size > 0 GROUP BY d.source, h, need),
k AS (SELECT source, h, need > 0 AND (upto < need OR (upto - words < need AND upto - need <= need - (upto - words))) AS more FROM c)
SELECT d.doc_id, d.size, tn.source_size, tn.target,
       CASE WHEN d.size > 0 THEN d.size * (tn.whole + CASE WHEN k.more THEN 1 ELSE 0 END) ELSE 0 END AS taken
FROM d JOIN tn ON d.source IS NOT DISTINCT FROM tn.source
LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kn: F.size(F.filter(base, lambda s: s["kn"] == kn)).cast("long")
    numbers = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.BASE_KINDS)]
    return found.select("doc_id", *numbers, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir))
    base = F.filter("findings", lambda f: f["kind"] == "base")
    words = F.transform(base, lambda f: f["word"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda f: f["label"])))
    labelled = F.transform(F.filter("findings", lambda f: f["kind"] != "tag"), lambda f: f["label"])
    labels = F.array_sort(F.array_distinct(F.concat(labelled, "tag_labels")))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score",
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = documents(spark, sf_dir), quality.QualityRules()
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"), rules)
    judged = quality.judge(docs, quality.fit(docs, trusted, rules), rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op11_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.write(documents(spark, sf_dir), f"{shared_dir(spark)}/tokenfile-{uuid.uuid4().hex}", tokenizer_path())
    return tokenfile.read(spark, path, with_ids=False)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed_order = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), seed_order)


def op13_sql(rounds: int = 10) -> str:
    """Each round assigns and moves by plain sums over all dimensions; ``c0`` to ``c10`` are the rounds' centroids."""
    nearest = lambda r: f"""
  SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT e.id, k.c, CAST(sum((e.x - k.x) * (e.x - k.x)) AS BIGINT) AS d FROM e JOIN c{r} k USING (i) GROUP BY ALL) GROUP BY id"""  # noqa: E731
    steps = "".join(
        f"""
a{r} AS MATERIALIZED ({nearest(r)}),
c{r + 1} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, k.x) AS x
  FROM c{r} k LEFT JOIN (SELECT a.c, e.i, CAST(sum(e.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN e USING (id) GROUP BY ALL) m USING (c, i)),"""
        for r in range(rounds)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
s AS (SELECT id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT CAST(s.c AS INTEGER) AS c, e.i, e.x FROM s JOIN e USING (id) WHERE s.c < 8),{steps}
f AS MATERIALIZED ({nearest(rounds)}),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT v.vec_id, f.c AS cluster, f.d AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM f JOIN v USING (id) JOIN h ON h.c = f.c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotes": op1_quotes,
    "op2_topk": op2_topk,
    "op3_packing": op3_packing,
    "op4_urllists": op4_urllists,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_licences": op9_licences,
    "op10_quality": op10_quality,
    "op11_tokenfile": op11_tokenfile,
    "op12_whitening": op12_whitening,
    "op13_clustering": op13_clustering,
}
ORACLE_SQL: dict[str, str] = {"op1_quotes": OP1_SQL, "op2_topk": OP2_SQL, "op4_urllists": OP4_SQL, "op5_mixing": OP5_SQL, "op13_clustering": op13_sql()}
