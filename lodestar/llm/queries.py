"""One query for each operator, over its whole table, with the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, hnsw, jaccard, langid, packing, pii, quality, repeats, secret_scan, suffix_lm
from lodestar.llm.common import fold
from lodestar.tables import table


def vocabulary() -> str:
    """Where the public vocabulary of the packing query lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _joined(spans) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def _digest(spans: DataFrame, base: tuple[str, ...]) -> list[Column]:
    """Counts of the base kinds and of all spans, the digest of the base spans, and all spans as text."""
    of = F.filter("spans", lambda x: x["kind"].isin(*base))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    return [*counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(_joined(of), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: patterns, and terms that disclose a protected value."""
    out = pii.spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_digest(out, pii.KINDS[:4]))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-tree and unigram scores of every document; fold 0 of 10 is held out."""
    out = suffix_lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur twice or more; n_shared: bytes in such of 240, a short passage of fifty words."""
    out = repeats.removed(table(spark, sf_dir, "documents"), short=240)

    def total(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])

    return out.select("doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("shared").alias("n_shared"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that occurs in it with at most a tenth of its bytes edited."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    out = quality.score(docs, forest, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents of fold 1 of 3 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    out = langid.predict(docs, model, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a cosine of 0.9 or more, by graphs of shards."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = v.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: patterns, and tokens that Markov models take for random strings."""
    out = secret_scan.spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_digest(out, secret_scan.KINDS[:3]))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, percent=85)


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


QUERIES = {"op1_pii": op1_pii, "op2_suffix_tree": op2_suffix_tree, "op3_repeats": op3_repeats, "op4_decontaminate": op4_decontaminate, "op5_packing": op5_packing, "op6_quality": op6_quality, "op7_language": op7_language, "op8_hnsw": op8_hnsw, "op9_secrets": op9_secrets, "op10_jaccard": op10_jaccard}
ORACLES: dict[str, str] = {"op8_hnsw": OP8_SQL, "op10_jaccard": OP10_SQL}
