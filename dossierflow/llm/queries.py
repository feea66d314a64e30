"""One query per operator over its whole table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm import centroids as op13
from dossierflow.llm import decontamination as op1
from dossierflow.llm import id_files as op8
from dossierflow.llm import language_id as op10
from dossierflow.llm import line_dedup as op4
from dossierflow.llm import mixing as op12
from dossierflow.llm import packing as op2
from dossierflow.llm import quality as op5
from dossierflow.llm import search as op11
from dossierflow.llm import secrets_scan as op6
from dossierflow.llm import simhash as op7
from dossierflow.llm import token_counts as op3
from dossierflow.llm import warc as op9
from dossierflow.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.id_file_round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.packed_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op9_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


ORACLES["op9_web_archives"] = """SELECT p.page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN largest IS NOT NULL AND largest <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest <> p.page_id THEN largest END AS refers_to
FROM pages p LEFT JOIN (SELECT html AS h, max(page_id) AS largest FROM pages WHERE strlen(html) >= 1000 GROUP BY html) g ON p.html = g.h"""


@query
def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of an item's five-word shingles, with the item."""
    return op1.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op1_benchmark_leaks"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT len(w) AS k FROM b WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0
  UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) FROM d, k WHERE len(w) >= k),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY 1, 2 HAVING 5 * count(*) >= 4 * any_value(n_item)"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later occurrences of three-line windows."""
    found = op4.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"),
                        F.array_join("removed_lines", ",").alias("removed_lines"))


ORACLES["op4_line_dedup"] = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
c AS (SELECT doc_id, pos, regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS t FROM l WHERE regexp_matches(line, '[^ \t-\r]')),
w AS (SELECT doc_id, pos, lead(pos, 1) OVER o AS p1, lead(pos, 2) OVER o AS p2, [t, lead(t, 1) OVER o, lead(t, 2) OVER o] AS k FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w WHERE p2 IS NOT NULL),
x AS (SELECT DISTINCT doc_id, unnest([pos, p1, p2]) AS pos FROM r WHERE nth > 1)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (x.pos IS NULL), '') AS text, count(*) AS n_lines, count(x.pos) AS n_removed,
  coalesce(string_agg(x.pos::VARCHAR, ',' ORDER BY x.pos), '') AS removed_lines
FROM l LEFT JOIN x USING (doc_id, pos) GROUP BY doc_id"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.quality(table(spark, sf_dir, "documents")).drop("digest")


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.secret_spans(table(spark, sf_dir, "documents"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.languages(table(spark, sf_dir, "documents"), PIECE_BPE)


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = r"""WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
it AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, t, count(*) AS tf FROM dt GROUP BY 1, 2),
d AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY 1),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM d),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY 1),
q AS (SELECT item_id, t, count(*) AS times FROM it GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // length))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN d USING (doc_id), c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.taken_report(*op12.mix(table(spark, sf_dir, "documents")))


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.cluster_report(*op13.clusters(table(spark, sf_dir, "embeddings")))


def _centroid_sql(rounds: int = 10) -> str:
    near = """a{r} AS MATERIALIZED (SELECT vec_id, x, h, d[1] AS distance, d[2]::INT AS cluster FROM (SELECT v.vec_id, any_value(v.x) AS x, any_value(v.h) AS h,
  min([list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT, c.j]) AS d FROM v, c{r} c GROUP BY v.rowid, v.vec_id))"""
    mean = """c{n} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT cluster, list(f ORDER BY i) AS x FROM (
  SELECT cluster, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1) m
  ON m.cluster = c.j)"""
    steps = [near.format(r=r) + ",\n" + mean.format(r=r, n=r + 1) for r in range(rounds)] + [near.format(r=rounds)]
    return """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rowid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x,
  sha256('3:' || vec_id::VARCHAR) AS h FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x FROM v QUALIFY row_number() OVER (ORDER BY h) <= 8),
""" + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.cluster"""


ORACLES["op13_centroids"] = _centroid_sql()
