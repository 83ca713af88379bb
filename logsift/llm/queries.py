"""One query for each operator, with production parameters over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import clustering, hard_negatives, language_id, line_dedup, minhash, mixing, packing, pii, quality_resample, quality_rules, sentencepieces, suffix_dedup
from logsift.llm import exact_dedup as exact


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file(), capacity=4096, end_id=1)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), minhash.Near(shingle=3, percent=85))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_sizes")[0].alias("source_size"),
        F.col("mix_targets")[0].alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), length=400).drop("kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_documents(spark, sf_dir).select("doc_id", "text"))
    base = [F.col(f"pii_{k}") for k in pii.BASE]
    every = [F.col(f"pii_{k.name}") for k in pii.KINDS]
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in zip(pii.BASE, base, strict=True)]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(*base), 256).alias("base_sha256"), pii.span_list(*every).alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.learn(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    return quality_resample.resample(_documents(spark, sf_dir).select("doc_id", "text"), good.select("doc_id"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode_and_decode(_documents(spark, sf_dir).select("doc_id", "text"), sentencepieces.vocabulary(tokenizer_file("piece_bpe_32k.model")))
    return found.select(
        "doc_id", (F.octet_length("sp_ids") / 4).cast("long").alias("n_tokens"), F.sha2("sp_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("sp_text").cast("binary"), 256).alias("decoded_sha256"),
    )


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(_embeddings(spark, sf_dir).select("vec_id", "embedding"), clustering.Settings(clusters=16, rounds=3))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _embeddings(spark, sf_dir).select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, "id % 100 = 0")


QUERIES = {"op1_packing": op1_packing, "op2_line_dedup": op2_line_dedup, "op3_minhash": op3_minhash, "op4_exact_dedup": op4_exact_dedup, "op5_mixing": op5_mixing, "op6_suffix_dedup": op6_suffix_dedup, "op7_pii": op7_pii, "op8_quality_rules": op8_quality_rules, "op9_language_id": op9_language_id, "op10_quality_classifier": op10_quality_classifier, "op11_sentencepiece": op11_sentencepiece, "op12_clustering": op12_clustering, "op13_hard_negatives": op13_hard_negatives}



def _clustering_sql(rounds: int = 3) -> str:
    """The rounds one after the other: nearest centroid of each vector, then floors of the means."""
    assign = """a{k} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, CAST(list_sum(list_transform(list_zip(v.x, m.x), lambda z : (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
      FROM v, m{k} AS m) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
    update = """u{k} AS MATERIALIZED (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{k} USING (vec_id)) GROUP BY c, i),
m{n} AS MATERIALIZED (SELECT m.c, coalesce(y.x, m.x) AS x FROM m{k} AS m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM u{k} GROUP BY c) AS y USING (c))"""
    steps = ",\n".join(f"{assign.format(k=k)},\n{update.format(k=k, n=k + 1)}" for k in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(64e0 * x) AS BIGINT)) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)),
{steps},
{assign.format(k=rounds)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN m{rounds} AS m USING (c)"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = {
    "op4_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UP}', '{_LOW}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op3_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM g),
x AS (SELECT doc_id, unnest(s) AS s FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n_shingles + q.n_shingles - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT e.b, r.reached FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
    "op5_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5('42:' || doc_id) AS k,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
      FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER r AS i, sum(n) OVER () - (sum(3 * n) OVER r - 3 * n) AS room,
             sum(w) OVER () - (sum(w) OVER r - w) AS shared
      FROM s WINDOW r AS (ORDER BY 3 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT i AS first_free, CAST(room AS DOUBLE) / CAST(shared AS DOUBLE) AS unit FROM o
      WHERE w * (CAST(room AS DOUBLE) / CAST(shared AS DOUBLE)) <= 3 * n ORDER BY i LIMIT 1),
t AS (SELECT source, n, CASE WHEN i < first_free THEN CAST(3 * n AS DOUBLE) ELSE w * unit END AS target FROM o, f),
c AS (SELECT d.*, n, target, CAST(floor(target) AS BIGINT) AS flow FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
w AS (SELECT source, flow, CAST(least(flow // greatest(sum(size), 1), 3) AS BIGINT) AS whole, CAST(sum(size) AS BIGINT) AS able
      FROM c WHERE size <= flow GROUP BY source, flow),
v AS (SELECT source, whole, CASE WHEN whole < 3 THEN flow - whole * able ELSE 0 END AS rest FROM w),
p AS (SELECT c.doc_id, c.source, c.size, c.k, v.whole, v.rest, sum(c.size) OVER (PARTITION BY c.source ORDER BY c.k, c.size) AS upto
      FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source WHERE c.size <= v.rest AND v.rest > 0),
g AS (SELECT source, rest, whole, rest - coalesce(max(upto) FILTER (upto <= rest), 0) AS gap FROM p GROUP BY source, rest, whole),
q AS (SELECT p.doc_id, p.source, p.size, p.k, upto <= p.rest AS first, g.gap, g.whole FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source),
h AS (SELECT source, size, whole, gap, count(*) FILTER (NOT first) AS fresh, count(*) AS n FROM q WHERE size > 0 AND size <= gap GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY level, size DESC) AS step
      FROM (SELECT source, gap, size, level, CASE WHEN level = 1 THEN fresh ELSE n END AS have FROM h, range(1, 4) AS l(level) WHERE whole + level <= 3)),
f2 AS (SELECT source, 0 AS step, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS level, CAST(0 AS BIGINT) AS take, CAST(gap AS BIGINT) AS left FROM g
       UNION ALL SELECT i.source, i.step, CAST(i.size AS BIGINT), CAST(i.level AS BIGINT), CAST(least(i.have, f2.left // i.size) AS BIGINT), CAST(f2.left - least(i.have, f2.left // i.size) * i.size AS BIGINT)
       FROM f2 JOIN i ON i.source IS NOT DISTINCT FROM f2.source AND i.step = f2.step + 1),
m AS (SELECT q.doc_id, f2.level, f2.take, row_number() OVER (PARTITION BY q.source, q.size, f2.level ORDER BY q.k) AS rn
      FROM q JOIN f2 ON q.source IS NOT DISTINCT FROM f2.source AND q.size = f2.size AND f2.take > 0 WHERE f2.level > 1 OR NOT q.first),
e AS (SELECT doc_id, count(*) AS more FROM m WHERE rn <= take GROUP BY doc_id)
SELECT c.doc_id, c.size, c.n AS source_size, c.target,
       CAST(c.size * (CASE WHEN c.size <= c.flow THEN coalesce(v.whole, 0) ELSE 0 END + CASE WHEN q.first THEN 1 ELSE 0 END + coalesce(e.more, 0)) AS BIGINT) AS taken
FROM c LEFT JOIN v ON c.source IS NOT DISTINCT FROM v.source LEFT JOIN q ON q.doc_id = c.doc_id LEFT JOIN e ON e.doc_id = c.doc_id""",
    "op12_clustering": _clustering_sql(),
    "op13_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x : floor(256e0 * x)) AS x
      FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x))) = 64),
s AS MATERIALIZED (SELECT a.id AS a, o.id AS o, a.label = o.label AS same, CAST(list_dot_product(a.x, o.x) AS BIGINT) AS score
      FROM v a JOIN v o ON a.id <> o.id WHERE a.id % 100 = 0),
p AS (SELECT a, o AS positive, score AS p FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, o) <= 5)
SELECT a AS anchor_id, positive AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, o AS negative_id, p AS positive_score, score AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 80 * p <= 100 * score AND score <= p
WINDOW w AS (PARTITION BY a, positive ORDER BY score DESC, o) QUALIFY row_number() OVER w <= 5""",
}
