"""Registered queries of the operators and their SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.llm import (
    filter_audit,
    fingerprints,
    license_scan,
    mixing,
    ngram_join,
    piece_codec,
    pii,
    repeats,
    secret_scan,
    token_count,
    topk,
    toxicity,
    whitening,
)
from keyferry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def number_of(spans: str, field: str, value) -> Column:
    """How many spans of an array have this value."""
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("pii", lambda s: s.kind.isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[number_of("pii", "kind", k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("pii")).alias("spans"),
    )


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(rule.kind) for rule in secret_scan.RULES])

    def text_of(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind_no), s.start, s.end)), ","
        )

    base = F.filter("secrets", lambda s: s.kind_no < len(secret_scan.BASE_KINDS))
    return found.select(
        "doc_id",
        *[number_of("secrets", "kind_no", n).alias(f"n_{k}") for n, k in enumerate(secret_scan.BASE_KINDS)],
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("secrets")).alias("spans"),
    )


#: The vocabulary of the token queries; every worker reads it at the place its own package names.
VOCABULARY = "piece_bpe_32k.model"


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY, limit=4096)


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_decode(table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.mix_counts(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.size("copies")).cast("long")
    return counted.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


ORACLE["op10_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vector, c.vector)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), links=True)


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM docs
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM worded LEFT JOIN marks USING (doc_id)
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l (letter, bit)
), orders AS (
  SELECT '' AS filter_order, 0 AS applied
  UNION ALL
  SELECT filter_order || letter, applied + bit FROM orders JOIN letters ON applied & bit = 0
), steps AS (
  SELECT filter_order, s.step::INTEGER AS step, l.letter, l.bit,
    (SELECT coalesce(sum(e.bit), 0) FROM letters e WHERE instr(substr(filter_order, 1, s.step::INTEGER - 1), e.letter) > 0)::INTEGER AS before
  FROM orders, range(1, 6) s (step), letters l
  WHERE applied = 31 AND l.letter = substr(filter_order, s.step::INTEGER, 1)
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask
), counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM steps, cells GROUP BY part, filter_order, step, letter
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.whole_vectors(table(spark, sf_dir, "embeddings")))


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))

    def names(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")

    base = F.filter("places", lambda p: p.base)
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).start.cast("long").alias("first_word"),
        F.array_max(base).start.cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.share)), F.lit(0.0)).alias("score"),
    )


def _templates() -> str:
    """The licence templates as a SQL table."""
    texts = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = [
        f"('{t.label}', {t.base}, {texts(t.key)}, {texts(t.notice)}, {len(t.before.split())})"
        for t in license_scan.TEMPLATES
    ]
    return f"(VALUES {', '.join(rows)}) t (label, base, key, notice, offs)"


ORACLE["op13_licenses"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), templates AS (
  SELECT * FROM {_templates()}
), placed AS (
  SELECT row, words, unnest(words) AS word, unnest(range(len(words))) AS pos FROM docs
), hits AS (
  SELECT p.row, p.pos, t.label, t.base,
    list_sum([CASE WHEN p.pos - t.offs + i >= 0 AND p.words[p.pos - t.offs + i + 1] = t.notice[i + 1] THEN 1 ELSE 0 END
      FOR i IN range(len(t.notice))]) / len(t.notice) AS share
  FROM placed p JOIN templates t ON p.word = t.key[1] AND p.words[p.pos + 1:p.pos + len(t.key)] = t.key
)
SELECT any_value(d.doc_id) AS doc_id, any_value(len(d.words))::BIGINT AS n_words,
  count(*) FILTER (base) AS n_base, (min(pos) FILTER (base))::BIGINT AS first_word, (max(pos) FILTER (base))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(share), 0)::DOUBLE AS score
FROM docs d LEFT JOIN hits h ON d.row = h.row GROUP BY d.row
"""
