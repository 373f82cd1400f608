"""The operators of this subpackage as named queries over the given tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.clustering import CENTROIDS, LARGEST, ROUNDS, SCALE, SEED, clusters
from graphlens.llm.decontamination import contamination
from graphlens.llm.encoding import default_tokenizer
from graphlens.llm.language_model import backoff_scores
from graphlens.llm.manifest import manifest
from graphlens.llm.license_scan import license_scan
from graphlens.llm.near_duplicates import near_duplicates
from graphlens.llm.packing import packed
from graphlens.llm.sharding import SHARDS, SLOTS, lookup_table, place
from graphlens.llm.substring_dedup import repeated
from graphlens.llm.token_counts import token_counts
from graphlens.llm.toxicity import score_documents
from graphlens.llm.vector_groups import vector_groups
from graphlens.llm.vector_search import nearest_neighbours

TOKEN_LIMIT = 1024


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in sequences of at most 2,048 tokens."""
    return packed(_table(spark, folder, "documents"), default_tokenizer())


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    return score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie inside a benchmark window."""
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Trigram score of every document under the counts of all others."""
    scored = backoff_scores(_table(spark, folder, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, from an empty cache."""
    counts = token_counts(_table(spark, folder, "documents"), default_tokenizer())
    return counts.withColumn("over_limit", counts["n_tokens"] > TOKEN_LIMIT)


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document."""
    return license_scan(_table(spark, folder, "documents"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words that every document keeps once passages of smaller documents are gone."""
    return repeated(_table(spark, folder, "documents"))


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return nearest_neighbours(_table(spark, folder, "embeddings"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return near_duplicates(_table(spark, folder, "documents"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Slot and shard of every document."""
    return place(_table(spark, folder, "documents"), "doc_id").select("doc_id", "slot", "shard")


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector after five rounds."""
    return clusters(_table(spark, folder, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and verification of every document."""
    return manifest(_table(spark, folder, "documents"))


def op13_vector_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Links and group of every vector at a cosine of 0.95."""
    return vector_groups(_table(spark, folder, "embeddings"))


def _cluster_oracle() -> str:
    """The rounds written out: assignment by rank over all distances, then exact floors of means."""
    ctes = [f"""q AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(greatest(least(x * {SCALE}, {LARGEST}), -{LARGEST})) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), long AS (SELECT r, unnest(q) AS x, unnest(range(1, 65)) AS pos FROM q
), chosen AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS c, q FROM q WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS}
), c0 AS (SELECT c, unnest(q) AS x, unnest(range(1, 65)) AS pos FROM chosen)"""]
    for k in range(ROUNDS + 1):
        ctes.append(f"""a{k} AS (
  SELECT r, c, d FROM (SELECT r, c, CAST(sum((long.x - c{k}.x) * (long.x - c{k}.x)) AS BIGINT) AS d FROM long JOIN c{k} USING (pos) GROUP BY r, c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < ROUNDS:
            ctes.append(f"""m{k} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM a{k} JOIN long USING (r) GROUP BY c, pos
), c{k + 1} AS (SELECT c, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x, pos FROM c{k} LEFT JOIN m{k} USING (c, pos))""")
    return "WITH " + ", ".join(ctes) + f"""
, digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS digest FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM a{ROUNDS} JOIN q USING (r) JOIN digests USING (c)
"""


def _merkle_oracle(levels: int = 14) -> str:
    """Trees of up to ``3 ** levels`` leaves, level by level; documents fold through the same runs."""
    said = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    ahead = " || ".join(said(c) for c in ("doc_id", "source", "lang", "n_chars"))
    ctes = [f"""crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT doc_id, source, sha256({ahead} || {said("text")}) AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 2 = 0
      THEN sha256({ahead} || {said("replace(text, chr(10), '')")}) ELSE leaf END AS start
  FROM documents, crc
), g AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, start) - 1 AS p FROM d
), n0 AS (SELECT g, p, leaf AS h FROM g
), f0 AS (SELECT g, p AS pos, doc_id, leaf, start AS folded, '' AS proof, p FROM g)"""]

    def level(nodes, walk, made, walked):
        # runs that are more than a lone root; a tree that is finished stays as it is
        ctes.append(f"""r_{made} AS (SELECT g, p // 3 AS p, list(h ORDER BY p) AS run, any_value(many) AS many FROM (SELECT *, count(*) OVER (PARTITION BY g) AS many FROM {nodes}) GROUP BY g, p // 3
), {made} AS (SELECT g, p, CASE WHEN many > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM r_{made}
), {walked} AS (
  SELECT w.g, w.pos, doc_id, leaf, w.p // 3 AS p,
    CASE WHEN many > 1 THEN sha256(array_to_string(run[1 : w.p % 3], '') || folded || array_to_string(run[w.p % 3 + 2 : 3], '')) ELSE folded END AS folded,
    CASE WHEN many > 1 THEN proof || array_to_string(run[1 : w.p % 3], '') || array_to_string(run[w.p % 3 + 2 : 3], '') ELSE proof END AS proof
  FROM {walk} w JOIN r_{made} r ON r.g = w.g AND r.p = w.p // 3)""")

    for k in range(levels):
        level(f"n{k}", f"f{k}", f"n{k + 1}", f"f{k + 1}")
    ctes.append(f"""s0 AS (SELECT 0 AS g, g AS p, h FROM n{levels}
), w0 AS (SELECT 0 AS g, pos, doc_id, leaf, f.folded, proof, f.g AS p, h AS subroot FROM f{levels} f JOIN n{levels} n ON n.g = f.g
), t0 AS (SELECT g, p * 1000000000 + pos AS pos, doc_id, leaf || subroot AS leaf, folded, proof, p FROM w0)""")
    for k in range(6):
        level(f"s{k}", f"t{k}", f"s{k + 1}", f"t{k + 1}")
    return "WITH " + ", ".join(ctes) + """
SELECT doc_id, leaf[1:64] AS leaf, leaf[65:128] AS subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM t6 JOIN s6 ON s6.g = t6.g
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_toxicity, op3_decontamination, op4_stupid_backoff, op5_token_counts,
        op6_license_scan, op7_substring_dedup, op8_nearest_neighbours, op9_simhash, op10_sharding, op11_centroid_clusters, op12_merkle_manifest, op13_vector_groups,
    )
}

ORACLES: dict[str, str] = {
    "op3_decontamination": r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS pattern
  FROM item_words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i) WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS pattern
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
), found AS (
  SELECT doc_id, d.n, i, item FROM doc_windows d JOIN item_windows p ON p.n = d.n AND p.pattern = d.pattern
), hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM found) GROUP BY doc_id
), items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM starts
), first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(13)) AS k FROM windows JOIN first USING (h) WHERE doc_id > least)
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op4_stupid_backoff": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (SELECT r, unnest(w) AS w3, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS (
  SELECT r, i, w3, lag(w3, 1) OVER doc AS w2, lag(w3, 2) OVER doc AS w1 FROM p WINDOW doc AS (PARTITION BY r ORDER BY i)
), keys AS (
  SELECT r, i, w3 AS g1, w2 || ' ' || w3 AS g2, w1 || ' ' || w2 || ' ' || w3 AS g3, w2 AS c2, w1 || ' ' || w2 AS c3 FROM g
), grams AS (SELECT r, unnest([g1, g2, g3]) AS t FROM keys
), per_doc AS (SELECT r, t, count(*) AS own FROM grams WHERE t IS NOT NULL GROUP BY r, t
), counts AS (SELECT r, t, sum(own) OVER (PARTITION BY t) - own AS n FROM per_doc
), size AS (SELECT r, len(w) AS words, sum(len(w)) OVER () - len(w) AS others FROM d
), s AS (
  SELECT k.r, others, CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, CAST(c.n AS DOUBLE) AS n3, CAST(d2.n AS DOUBLE) AS m2, CAST(d3.n AS DOUBLE) AS m3, g2, g3
  FROM keys k JOIN size USING (r) JOIN counts a ON a.r = k.r AND a.t = g1 LEFT JOIN counts b ON b.r = k.r AND b.t = g2 LEFT JOIN counts c ON c.r = k.r AND c.t = g3
  LEFT JOIN counts d2 ON d2.r = k.r AND d2.t = c2 LEFT JOIN counts d3 ON d3.r = k.r AND d3.t = c3
), logs AS (
  SELECT r, CASE
    WHEN n3 > 0 THEN ln(n3 / m3)
    WHEN n2 > 0 THEN ln(n2 / m2) + (g3 IS NOT NULL)::INT * ln(0.4)
    WHEN n1 > 0 THEN ln(n1 / others) + ((g3 IS NOT NULL)::INT + (g2 IS NOT NULL)::INT) * ln(0.4)
    ELSE -ln(others + 1) + ((g3 IS NOT NULL)::INT + (g2 IS NOT NULL)::INT + 1) * ln(0.4) END AS x
  FROM s
), sums AS (SELECT r, sum(x) AS x FROM logs GROUP BY r)
SELECT doc_id, words AS n_words, round(coalesce(x, 0), 6) AS log_score, round(x / words, 6) AS mean_log_score
FROM d JOIN size USING (r) LEFT JOIN sums USING (r)
""",
    "op8_nearest_neighbours": r"""
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda k: (q.v[k] - c.v[k]) * (q.v[k] - c.v[k])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op10_sharding": f"""
WITH owners AS (SELECT string_split('{",".join(map(str, lookup_table(SHARDS, SLOTS)))}', ',') AS o, string_split('{",".join(SHARDS)}', ',') AS names
), placed AS (
  SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS INTEGER) AS slot FROM documents
)
SELECT doc_id, slot, names[o[slot + 1]::INTEGER + 1] AS shard FROM placed, owners
""",
    "op11_centroid_clusters": _cluster_oracle(),
    "op12_merkle_manifest": _merkle_oracle(),
    "op13_vector_groups": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), fit AS (
  SELECT r, vec_id, list_transform(v, lambda x: x / list_aggregate(list_transform(v, lambda y: abs(y)), 'max')) AS v FROM v
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (SELECT a.r AS a, b.r AS b FROM fit a JOIN fit b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (SELECT r, r AS other FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other
), least AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.other GROUP BY reach.r
), counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN counted USING (r)
""",
}
