"""The registered queries of this subpackage: each applies one operator, with production parameters, to its
whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, licenses, media, negatives, packing, quality, ranking, resharding, simhash, spencode, toxicity, urlfilter, warc
from .common import held_out, joined, of_row, shipped, table, written

def tokenizer_path(spark: SparkSession, name: str) -> str:
    """A public tokenizer's file, which the executors get too."""
    import public_tokenizers

    return shipped(spark, public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, decoded again."""
    return spencode.checked(table(spark, sf_dir, "documents"), tokenizer_path(spark, "piece_bpe_32k.model"))


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, laid out in five shards and then resharded to eight of nearly equal bytes."""
    old = resharding.laid_out(resharding.sized(table(spark, sf_dir, "documents")), 5)
    whole = F.coalesce(of_row("text"), F.lit(""))
    stored = resharding.resharded(old, 8).select(of_row("doc_id").alias("doc_id"), (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(whole).alias("text_crc32"), "shard")
    rows = resharding.slotted(stored, F.col("doc_id"))  # slots need no texts
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    tokens = written(packing.tokenized(table(spark, sf_dir, "documents"), tokenizer_path(spark, "word_bpe_49k.json")), "packing-tokens")
    return packing.packed(tokens)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model).withColumn("doc_id", of_row("doc_id"))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), "toxicity.n_sentences", "toxicity.worst_sentence", "toxicity.offending")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each licence passage in any document."""
    return licenses.found(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stats = written(found.select(F.struct(of_row("doc_id").alias("doc_id")).alias("row"), "rules"), "quality-statistics")
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    return quality.judged(stats, model).select("row.doc_id", "rules.*", "base_failed", "kept", "excess")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.clustered(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = written(media.listed(docs), "media-manifest")
    found = written(media.verified(rows, media.stored(docs, rows)), "media-verified")
    return joined(rows.select("doc_id", "n_bytes", "medium"), found, "medium").drop("medium")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.bundled(warc.decided(table(spark, sf_dir, "pages")))
    return warc.read_back(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def listed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of op10: the hosts of six names below every domain that any page's host lies in, and below domains of customers,
    which no page has."""
    host, _ = urlfilter.split_url(F.col("url").cast("string"))
    keys = urlfilter.host_keys(F.col("host"))
    domains = table(spark, sf_dir, "pages").select(host.alias("host")).distinct().select(F.explode(F.slice(keys, 2, F.greatest(F.size(keys), F.lit(1)))).alias("domain"))
    absent = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"), F.lit(".example")).alias("domain"))
    names = F.explode(F.array(*map(F.lit, urlfilter.LISTED))).alias("name")
    below = domains.unionByName(absent).distinct().select(names, "domain").select(F.concat_ws(".", "name", "domain").alias("key"))
    return below.unionByName(spark.range(1).select(names).select(F.col("name").alias("key")))


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = written(listed_hosts(spark, sf_dir), "listed-hosts")
    return urlfilter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("row.page_id", "host", "path", "rule", "verdict")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All damaged conversations, repaired."""
    rows = table(spark, sf_dir, "conversations")
    report, turns = conversations.repaired(conversations.damaged(rows), also=rows)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return report.join(conversations.digests(turns), "k", "left").select(*columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, among all; every seventh has a wrong label."""
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(negatives.prepared(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", number % 50 == 0))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ranking.scored(docs, ranking.fit(docs, table(spark, sf_dir, "labels"))).withColumn("doc_id", of_row("doc_id"))
    return found.select("doc_id", held_out(folds=4, rest=2).alias("held_out"), F.col("quality.score").alias("score"), (F.col("quality.score") >= 0.7).cast("int").alias("predicted"), "quality.strength")


URLFILTER_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM cut
), split AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN len(list_intersect(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])) > 0 THEN 'block'
    ELSE 'allow' END AS verdict FROM ruled
"""

#: CRC-32 byte by byte, then the cheapest audits to each state of the grammar, turn by turn.
CONVERSATIONS_SQL = r"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
), labelled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS codes FROM conversations
), faulty AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, codes), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS f FROM labelled, crcs
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faulty, range(2) AS r(k) WHERE f <> 0 AND (k = 0 OR f = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, substr(role, 1, 1) AS x FROM damaged
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN '.' ELSE 't' END AS fault,
         lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY conv_id
), moves(q, added, p) AS (
  VALUES ('0', '', '0'), ('0', 'I', 'u'), ('0', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'), ('u', '', 'u'), ('u', 'I', 'a'), ('u', 'II', 'u'), ('a', '', 'a'), ('a', 'I', 'u'), ('a', 'II', 'a')
), edits(p, edit, x, price, r) AS (
  SELECT q, 'D', NULL::VARCHAR, 3, q FROM (VALUES ('0'), ('s'), ('u'), ('a')) AS t(q) UNION ALL
  VALUES ('0', 'K', 's', 0, 's'), ('0', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('a', 'K', 'u', 0, 'u'), ('u', 'K', 'a', 0, 'a'), ('0', 'R', NULL::VARCHAR, 2, 'u'), ('s', 'R', NULL::VARCHAR, 2, 'u'), ('a', 'R', NULL::VARCHAR, 2, 'u'), ('u', 'R', NULL::VARCHAR, 2, 'a')
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS q, {'cost': 0::BIGINT, 'audit': ''} AS best FROM facts
  UNION ALL
  SELECT w.conv_id, w.i + 1, r, min({'cost': best.cost + 2 * length(added) + price + CASE WHEN edit <> 'D' AND fault = 't' THEN 1 ELSE 0 END, 'audit': best.audit || added || edit})
  FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 JOIN moves USING (q) JOIN edits e USING (p)
  WHERE (e.x IS NULL OR e.x = m.x) AND (edit = 'D' OR fault NOT IN ('b', 'd')) GROUP BY w.conv_id, w.i, r
), ended AS (
  SELECT f.conv_id, min({'cost': best.cost + 2 * length(added), 'audit': best.audit || added}) AS best
  FROM ways w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = f.n JOIN moves USING (q) WHERE p IN ('0', 'a') GROUP BY f.conv_id
), walked AS (
  SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS i, '0' AS q, best.audit AS audit, ''::VARCHAR AS line FROM ended
  UNION ALL
  SELECT w.conv_id, k + 1, CASE WHEN c.edit = 'I' THEN w.i ELSE w.i + 1 END,
         CASE c.edit WHEN 'D' THEN q WHEN 'K' THEN m.x ELSE CASE WHEN q = 'u' THEN 'a' ELSE 'u' END END, audit,
         CASE c.edit WHEN 'D' THEN NULL WHEN 'K' THEN m.role || ':' || m.text ELSE CASE WHEN q = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN c.edit = 'R' THEN m.text ELSE '' END END
  FROM walked w, LATERAL (SELECT substr(w.audit, w.k::INT + 1, 1) AS edit) c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
  WHERE k < length(audit)
), joined AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY k) FILTER (k > 0 AND line IS NOT NULL) AS whole FROM walked GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM o.conv_id
"""

NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (html)
"""

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_resharding, op3_packing, op4_toxicity, op5_licenses, op6_quality, op7_simhash, op8_media, op9_warc, op10_urlfilter, op11_conversations, op12_negatives, op13_ranking)}
#: op9's SHA-1 in base 32 isn't SQL, so its SQL above serves a test of the other columns.
ORACLES: dict[str, str] = {"op10_urlfilter": URLFILTER_SQL, "op11_conversations": CONVERSATIONS_SQL, "op12_negatives": NEGATIVES_SQL}
