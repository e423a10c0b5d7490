"""One query for each operator, and its SQL where SQL can say it. The queries are thin: rows come through the operators."""

from __future__ import annotations

import functools
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, clustering, decontam, htmltext, langid, mixing, quality, sharding, simhash, urlfilter, warc, whitening
from .common import crc_of, durable, shared_dir, table

#: Half of the mix for the one source that holds a third of the rows here would be too much: it gets a tenth.
MIX_WEIGHTS = {"src0": 2.0}
MIX_DEFAULT = 1.0
MIX_SEED = 20
SHARDS = 24
SHARD_SEED = 4


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of("doc_id") % 3 == 1
    model = langid.train(docs.where(~held_out).select("text", "lang"))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, r, w FROM (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\xBF\x{2000}-\x{206F}\x{3000}-\x{303F}]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0),
     b AS (SELECT item_id, w FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\xBF\x{2000}-\x{206F}\x{3000}-\x{303F}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
     ds AS (SELECT DISTINCT doc_id, r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d)),
     bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b)),
     n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_item FROM bs GROUP BY item_id),
     c AS (SELECT doc_id, r, item_id, CAST(count(*) AS INTEGER) AS n_common FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, max(n_common) AS n_common, max(n_common) / n_item AS containment
FROM c JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING max(n_common) >= ceil(n_item * 0.8 - 1e-9)
"""


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS, SHARD_SEED)
    return shard_digest(shuffled)


def shard_digest(shuffled: DataFrame) -> DataFrame:
    size, crc = sharding.text_bytes() + 8, sharding.text_crc()
    return shuffled.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    space = quality.fit(docs, labels.where(crc_of("doc_id") % 5 != 0))
    held_out = crc_of("doc_id") % 5 == 0
    scored = quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), space).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


#: Both turns of the conversation that is added to test the escaping.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(rows))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = posixpath.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    # two passes with pushed predicates: responses with their payloads, and revisits, for which no payload is read
    read = functools.partial(warc.read_archive, spark, path)
    own = [F.col("page_id").cast("bigint").alias("page_id")]
    # what is kept of a response is narrow, and needed twice: written once, so that payloads are read once
    responses = durable(read().where("warc_type = 'response'").select(*own, F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type")))
    revisits = read().where("warc_type = 'revisit'").select(*own, F.col("payload_digest").alias("said"), F.col("refers_to").cast("bigint").alias("refers_to"), F.col("warc_type").alias("record_type"))
    # a revisit's payload is that of the response it names: the digests must agree, or it has none
    named = responses.where(F.col("payload_bytes") >= warc.REVISIT_BYTES).select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said"), "payload_bytes").distinct()
    again = revisits.join(named, ["refers_to", "said"], "left")
    told = again.select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("said")).alias("payload_digest"), "record_type", "refers_to")
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(told)


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_DEFAULT, seed=MIX_SEED)
    return mixed.select("doc_id", "source", "mix_row", "mix_copy", "mix_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP10_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, CASE WHEN source = 'src0' THEN 2.0 ELSE 1.0 END AS w FROM documents GROUP BY source),
  rate AS (SELECT source, CAST(w AS DOUBLE) / CAST(sum(w) OVER () AS DOUBLE) * CAST(sum(n) OVER () AS DOUBLE) / n AS r FROM counts),
  part AS (SELECT source, r, CAST(greatest(ceil(r / 256.0), 1) AS INTEGER) AS parts FROM rate),
  pmf AS (SELECT source, parts, r / parts AS m, 0 AS k, exp(-r / parts) AS p, exp(-r / parts) AS c FROM part
          UNION ALL SELECT source, parts, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM pmf WHERE k < least(ceil(m + 12 * sqrt(m) + 20), 1023)),
  cdf AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM pmf GROUP BY ALL),
  named AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS mix_row FROM documents),
  drawn AS (SELECT d.*, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_md5 || ':' || mix_row AS name, cs, unnest(range(1, parts + 1)) AS part FROM named d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
  counted AS (SELECT *, len(list_filter(cs, lambda c: c < (CAST('0x' || substr(md5('20:' || name || ':' || part), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) AS n FROM drawn),
  copies AS (SELECT doc_id, source, text_md5, mix_row, name, CAST(unnest(range(1, n + 1)) + (part - 1) * 1024 AS INTEGER) AS mix_copy FROM counted)
SELECT doc_id, source, mix_row, mix_copy, md5('20/order:' || name || ':' || mix_copy) AS mix_key, text_md5 FROM copies
"""

#: Which addresses are allowed or blocked whatever their words.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _words_sql(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _rule_sql(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'"


#: Words between boundaries are the pieces between characters that are no letters or digits.
OP11_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
     w AS (SELECT *, regexp_split_to_array(lower(url_decode(host || path)), '[^\p{{L}}\p{{N}}]+') AS words,
             CASE {" ".join(_rule_sql(r) for _, r in sorted(URL_RULES, key=lambda x: -len(x[1])))} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {" ".join(f"WHEN '{r}' THEN '{v}'" for v, r in URL_RULES)}
  ELSE CASE WHEN len(list_intersect(words, {_words_sql(urlfilter.STRICT)})) >= 1 OR len(list_intersect(words, {_words_sql(urlfilter.SOFT)})) >= {urlfilter.REJECT} THEN 'block' ELSE 'allow' END END AS verdict FROM w
"""


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return clustering.cluster(rows, k=16, rounds=3, dim=64, scale=64.0, seed=1).drop("embedding")


def _lloyd_sql(i: int) -> str:
    """Round i: assignment to the centroids c{i}, and the centroids c{i + 1}."""
    return f"""d{i} AS (SELECT r, q, c, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, (SELECT c, q AS m FROM c{i})),
     a{i} AS (SELECT r, q, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
     s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j),
     c{i + 1} AS (SELECT c, coalesce(m, q) AS q FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c) USING (c))"""


OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
       WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
     c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT 16)),
     {", ".join(_lloyd_sql(i) for i in range(4))}
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN c3 ON c3.c = a3.c
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=32, scale=64.0, shift=1_000_000)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_sharding": op4_sharding,
    "op5_html_text": op5_html_text,
    "op6_quality": op6_quality,
    "op7_chat_format": op7_chat_format,
    "op8_warc": op8_warc,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_mixing": op10_mixing,
    "op11_url_filter": op11_url_filter,
    "op12_clustering": op12_clustering,
    "op13_whitening": op13_whitening,
}
SQL = {"op2_decontamination": OP2_SQL, "op8_warc": OP8_SQL, "op10_mixing": OP10_SQL, "op11_url_filter": OP11_SQL, "op12_clustering": OP12_SQL}
