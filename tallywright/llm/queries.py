"""The registered queries of this folder and, where SQL can state the result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import kd_shards as kd
from tallywright.llm import (
    centroids,
    collocations,
    cross_parsing,
    decontaminate,
    duckdb_bpe,
    exact_groups,
    line_templates,
    order_minhash,
    pii_crf,
    subspace_join,
    toxic_segments,
    warc,
)
from tallywright.llm.common import table

SHARDS = 40
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CENTROIDS, ROUNDS, DIMENSIONS = 40, 5, 64


def op1_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.record_table(warc.archive_round_trip(table(spark, folder, "pages")))


def op3_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    n_lines = F.size(line_templates.lines_of(F.col("text"))).cast("long")
    found = line_templates.drop_recurring_lines(docs.withColumn("n_lines", n_lines))
    return found.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), "dropped_lines", "text")


def op4_subspace_join(spark: SparkSession, folder: str) -> DataFrame:
    return subspace_join.linked_vectors(table(spark, folder, "embeddings"), threshold=0.98)


def _remainder(divisor: int) -> Column:
    """crc32 of the id as text, by which rows are held out from learning; a null id counts as an empty one."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % divisor


def op5_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learn = docs.filter(_remainder(4) != 2)
    found = cross_parsing.identify(docs.select("doc_id", "text"), learn)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


def op7_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd.kd_shards(table(spark, folder, "documents"), shards=SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def token_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`docs` with token_ids and the bytes decoded from these."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return duckdb_bpe.round_trip(docs, path, public_tokenizers.PATTERN)


def op8_duckdb_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = token_ids(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """`docs` with their toxicity, learnt from the labelled documents of `folder` that are not held out."""
    learn = table(spark, folder, "documents").filter(_remainder(3) != 1)
    labels = table(spark, folder, "labels").filter(_remainder(3) != 1)
    return toxic_segments.score_toxicity(docs, learn, labels)


def op9_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity(spark, table(spark, folder, "documents").select("doc_id", "text"), folder)
    return found.select(
        "doc_id",
        (_remainder(3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        toxic_segments.toxic(F.col("toxicity")).alias("predicted"),
        F.size("toxic_passages").cast("long").alias("n_passages"),
    )


def op10_pii_crf(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_crf.personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    joined = lambda spans: F.array_join(  # noqa: E731
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii_crf.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )


def op11_exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_groups.exact_groups(table(spark, folder, "documents"), every_digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op12_threshold_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.clusters(table(spark, folder, "embeddings"), CENTROIDS, ROUNDS, DIMENSIONS)
    return centroids.with_inertia(found)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_warc": op2_warc,
    "op3_line_templates": op3_line_templates,
    "op4_subspace_join": op4_subspace_join,
    "op5_cross_parsing": op5_cross_parsing,
    "op6_order_minhash": op6_order_minhash,
    "op7_kd_shards": op7_kd_shards,
    "op8_duckdb_bpe": op8_duckdb_bpe,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_pii_crf": op10_pii_crf,
    "op11_exact_groups": op11_exact_groups,
    "op12_threshold_centroids": op12_threshold_centroids,
    "op13_collocations": op13_collocations,
}

# Every agreement of a document's and an item's words, and how many lie in a window on the same diagonal.
_LEAKS = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents
), b AS (
  SELECT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark
), dw AS (
  SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), bw AS (
  SELECT item_id, len(w) AS n, least(len(w), 20) AS win, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM b
  WHERE len(w) >= 8
), met AS (
  SELECT doc_id, item_id, size, n, win, p - q AS diagonal, q FROM dw JOIN bw USING (word)
), starts AS (
  SELECT doc_id, item_id, win, diagonal, greatest(1, 1 - diagonal) AS low, least(n, size - diagonal) - win + 1 AS high, q,
         count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS ahead
  FROM met
), likely AS (
  SELECT DISTINCT doc_id, item_id, win, diagonal, low, high FROM starts
  WHERE high >= low AND ahead >= win - CAST(floor(win * 0.2 + 1e-9) AS INTEGER)
), windows AS (
  SELECT doc_id, item_id, win, diagonal, unnest(range(low, high + 1)) AS s FROM likely
), counted AS (
  SELECT w.doc_id, w.item_id, w.win, w.s, w.diagonal, count(*) AS matched
  FROM windows w JOIN met m ON m.doc_id = w.doc_id AND m.item_id = w.item_id AND m.diagonal = w.diagonal
   AND m.q >= w.s AND m.q < w.s + w.win
  GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, s + diagonal) AS r FROM counted
  WHERE matched >= win - CAST(floor(win * 0.2 + 1e-9) AS INTEGER)
)
SELECT doc_id, item_id, matched, CAST(win AS BIGINT) AS window_words, s + diagonal - 1 AS start_word FROM ranked WHERE r = 1
"""

_WARC = """
WITH pages_ AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS bytes FROM pages
), firsts AS (
  SELECT body, max(page_id) AS first_id FROM pages_ WHERE bytes >= 1000 GROUP BY body
)
SELECT p.page_id, p.bytes AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to,
       CASE WHEN f.first_id <> p.page_id THEN 1
            ELSE greatest(1, CAST(ceil(p.bytes / 1048576) AS BIGINT)) END AS chunks
FROM pages_ p LEFT JOIN firsts f USING (body)
"""

_LINKED = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e
JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _rounds_of_clusters(rounds: int) -> str:
    """Every round as an assignment to all centroids and the means of it; lists of integers throughout."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT v.vec_id, min(struct_pack(d := CAST({distance} AS BIGINT), cluster := c.cluster)) AS best FROM vectors v, c{i} c GROUP BY v.vec_id
)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY dim) AS x FROM (
    SELECT cluster, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
      SELECT cluster, dim, CAST(sum(value) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT a.best.cluster AS cluster, unnest(v.x) AS value, generate_subscripts(v.x, 1) AS dim
        FROM a{i} a JOIN vectors v USING (vec_id)) GROUP BY ALL)) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN s{i} s USING (cluster)
)"""
            )
    return ",\n".join(steps)


_CLUSTERS = f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, x FROM vectors
  QUALIFY cluster < {CENTROIDS}
), {_rounds_of_clusters(ROUNDS)}
SELECT a.vec_id, a.best.cluster AS cluster, a.best.d AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.best.cluster
"""

# All runs of one to five words, counted by their text.
_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?
-]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), runs AS (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, range(1, 6) sizes(size)
), f AS MATERIALIZED (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), split AS (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), held AS (
  SELECT s.lang, s.phrase, s.a FROM split s JOIN split o ON o.lang = s.lang AND o.size > s.size
   AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * o.a >= 100 * s.a
), cuts AS (
  SELECT *, unnest(range(1, size)) AS k FROM split WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM held)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n,
         CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score, c.k
  FROM cuts c JOIN totals t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op11_exact_groups": _EXACT,
    "op12_threshold_centroids": _CLUSTERS,
    "op13_collocations": _PHRASES,
    "op1_spaced_seeds": _LEAKS,
    "op4_subspace_join": _LINKED,
    "op2_warc": _WARC,
}
