"""The registered queries of these operators and, where SQL can express one, the same in SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann
from .chunk_dedup import repeated_passages
from .common import table
from .decontaminate import contamination
from .hard_negatives import integer_rows, mine
from .id_planes import read_ids, write_ids
from .licenses import scan_licenses
from .near_dedup import near_duplicates
from .piece_codec import encode_checked
from .quality import score_quality, train_quality
from .runs import collapse_runs
from .secrets import secret_report
from .token_count import count_tokens
from .toxicity import score_toxicity, train_toxicity


def held_out(mod: int, rest: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


def judged(scores: DataFrame, mod: int, rest: int) -> DataFrame:
    """doc_id, held_out, score, predicted and what else scores have; one row per row of scores, whatever their ids and nulls."""
    more = [c for c in scores.columns if c not in ("doc_id", "score")]
    return scores.select("doc_id", F.coalesce(held_out(mod, rest), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *more)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the offending tokens' byte offsets. Cases as in score_toxicity()."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judged(score_toxicity(docs, train_toxicity(docs, labels.where(~held_out(4, 2))), spans=True), 4, 2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document. Cases as in score_quality()."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judged(score_quality(docs, train_quality(docs, labels.where(~held_out(5, 0)))), 5, 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document. Cases as in count_tokens()."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Cases as in find_windows()."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document and their round trip. Cases as in encode_checked()."""
    import public_tokenizers

    return encode_checked(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id 20 divides. Cases as in ann.search()."""
    return ann.search(table(spark, sf_dir, "embeddings"), 20, 20)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that others hold too. Cases as in repeated_passages()."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document. Cases as in scan_licenses()."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. Cases as in scan_secrets()."""
    return secret_report(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents. Cases as in near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"), (85, 100))


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids in files of id planes, as read from the files. Cases as in write_ids()."""
    import public_tokenizers

    files = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of one document in ten, told by its id, with a tail in which a few words return again and again; others as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-((a - n) // p)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and digests of all of them and of the words that are kept. Cases as in collapse_runs()."""
    found = collapse_runs(table(spark, sf_dir, "documents"), 12, repeat_tail)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    rows = found.withColumn("best", longest).withColumn("length", -F.col("best.less"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
        F.expr("1000 * length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id 100 divides. Cases as in integer_rows() and mine()."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(integer_rows(table(spark, sf_dir, "embeddings").withColumn("label", moved)), 100)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id)
SELECT r.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda s, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(s, b)), 4294967295), 4294967295) AS h FROM d),
t AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM t),
e AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM e, unnest(range(n - 5)) AS u(i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM k GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM l WHERE length >= 12 AND length >= 2 * q GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM r, unnest(range(start + period, start + length)) AS u(i)),
words AS (SELECT doc_id, i, w[i + 1] AS x FROM e, unnest(range(n)) AS u(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
       CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_piece_codec": op4_piece_codec,
    "op5_nearest": op5_nearest,
    "op6_licenses": op6_licenses,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_planes": op11_token_planes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op9_near_dedup": OP9_SQL, "op12_periodic_runs": OP12_SQL, "op13_hard_negatives": OP13_SQL}
