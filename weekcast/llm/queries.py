"""Queries of the training-data operators and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm import (
    decontaminate, divergence, exact_dedup, hard_negatives, language, licenses, near_dup, packing, quality, shuffle_shards, token_shards,
    toxicity, warc)
from weekcast.llm.common import UPPER, LOWER, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file() -> str:
    """The vocabulary file of a public tokenizer, as installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op3_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h
           FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)"""


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    written = shuffle_shards.write_shards(read_table(spark, folder, "documents"), shards=24)
    return written.select(
        "doc_id", shuffle_shards.record_bytes().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), tokenizer_file(), digest=True)


@query
def op5_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    path = token_shards.write_token_shards(
        read_table(spark, folder, "documents"), tokenizer_file())
    return token_shards.read_token_shards(spark, path).drop("ids")


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontaminate.contamination(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                         "contaminated")


_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE["op1_decontamination"] = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
                               lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM item WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w
       FROM doc, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, i, spots.n, item FROM spots JOIN item_windows t
         ON t.n = spots.n AND t.g = array_to_string(w[i:i + spots.n - 1], ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items,
                     string_agg(DISTINCT item, ',' ORDER BY item) AS items
              FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


@query
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dup.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept")


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType
    made = warc.convert(spark, warc.write_arc(pages), smallest=0, id_type=kind)
    return warc.page_records(spark, made, kind)


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = toxicity.fit(docs, read_table(spark, folder, "labels"))
    return toxicity.score(docs, model).drop("row")


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(read_table(spark, folder, "documents"),
                           read_table(spark, folder, "labels")).drop("row")


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read_table(spark, folder, "documents")).drop("row")


def _license_sql() -> str:
    """Shingles that texts share with notices, counted by window."""
    listed = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
    rows = ", ".join(
        f"('{p.license}', {p.number}, {p.size}, {licenses.window_of(len(p.words))}, "
        f"{licenses.step_of(len(p.words))}, {listed(' '.join(s) for s in p.shingles)}, "
        f"{listed(p.must)}::VARCHAR[], {p.decisive})"
        for p in licenses.parts_of(licenses.read_notices()))
    sizes = range(1, licenses.SHINGLE + 1)
    runs = ", ".join(" || ' ' || ".join(["x", *(f"lead(x, {i}) OVER o" for i in range(1, n))])
                     + f" AS x{n}" for n in sizes)
    places = " UNION ALL ".join(
        f"SELECT r, pos, {n} AS size, x{n} AS g FROM runs WHERE x{n} IS NOT NULL" for n in sizes)
    return f"""
WITH notice(license, part, size, span, step, own, must, decisive) AS (VALUES {rows}),
own AS (SELECT license, part, size, span, step, len(own) AS n_own, unnest(own) AS g FROM notice),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM doc),
runs AS (SELECT r, pos, {runs}
         FROM word WINDOW o AS (PARTITION BY r ORDER BY pos)),
places AS ({places}),
met AS (SELECT r, license, part, step, span, n_own, g,
               unnest(range(CAST(greatest(0, ceil((pos + size - span) / step)) AS BIGINT),
                            pos // step + 1)) AS k
        FROM places JOIN own USING (size, g)),
shared AS (SELECT r, license, part, k * step AS s, any_value(span) AS span,
                  count(DISTINCT g) / any_value(n_own) AS share
           FROM met GROUP BY r, license, part, k, step
           HAVING share >= {licenses.CONTAINMENT}),
found AS (SELECT r, doc_id, license, part, s, share, decisive
          FROM shared JOIN notice USING (license, part) JOIN doc USING (r)
          WHERE len(list_filter(must, lambda m: NOT contains(
            ' ' || array_to_string(w[s + 1:s + shared.span], ' ') || ' ', ' ' || m || ' '))) = 0)
SELECT doc_id, license, count(DISTINCT part) AS parts, count(*) AS windows,
       max(share) AS containment, CAST(min(s) AS INTEGER) AS start
FROM found GROUP BY r, doc_id, license HAVING bool_or(decisive)"""


ORACLE["op8_license_scan"] = _license_sql()


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(read_table(spark, folder, "documents"))


ORACLE["op12_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                     '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
           FROM documents),
occurs AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM occurs
         GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
per_lang AS (SELECT lang, count(*) AS v, sum(n_lang) AS n_all FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n
      FROM occurs SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n_group AS (SELECT lang, source, sum(n) AS n_group FROM n GROUP BY ALL),
full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
         1 + (1000000000 * (coalesce(n.n, 0) + 5)::HUGEINT)
             // (coalesce(s.n_group, 0) + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000 * (k.n_lang + 5)::HUGEINT) // (l.n_all + 5 * l.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN per_lang l USING (lang)
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
  LEFT JOIN n_group s ON s.lang = g.lang AND s.source = g.source),
priced AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
           FROM full_counts a JOIN full_counts b USING (lang, term)
           WHERE a.source <> b.source GROUP BY ALL),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item,
         CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN priced p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM full_counts
  WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
                                             ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = language.fit(docs, ~language.held_out())
    return language.languages(docs, model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLE["op11_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, o.r, o.vec_id, a.label = o.label AS same,
                  CAST(list_dot_product(a.x, o.x) AS BIGINT) AS score
           FROM v a JOIN v o ON a.r <> o.r WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (
              PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id, n.r)
            AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id, n.r) <= 3"""
