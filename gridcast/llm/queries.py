"""The operators bound to the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import (
    dart_minhash, decontaminate, fill_middle, hard_negatives, language, line_dedup, mixing, neighbours, secret_scan, sharding, substring_dedup,
    token_counts, toxicity,
)
from gridcast.llm.store import fresh_path, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals
), ordered AS (
  SELECT *, 3.0 * source_size / weight AS stop_level,
    coalesce(sum(3 * source_size) OVER before, 0) AS given, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight,
    sum(source_size) OVER () AS whole
  FROM weighted WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT (whole - given)::DOUBLE / open_weight AS level FROM ordered
  WHERE stop_level >= (whole - given)::DOUBLE / open_weight ORDER BY stop_level LIMIT 1
), targets AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, weight * level) AS target FROM weighted, leveled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS place,
    CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS each_units,
    ('0x' || substr(md5('mix-1' || coalesce('=' || s.source, '-')), 1, 6))::BIGINT AS off
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * ((((place + 1) * each_units + off) >> 24) - ((place * each_units + off) >> 24)))::BIGINT AS taken
FROM placed
"""


@query("op1_mix", OP1_SQL)
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document by a mix of 5, 2, 1."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mixing.mix_plan(rows).select("doc_id", "size", "source_size", "target", "taken")


OP5_KINDS = {r.kind: r for r in secret_scan.RULES}


def _spans_sql(rule: secret_scan.Rule) -> str:
    m, g, p = f"m_{rule.kind}", f"g_{rule.kind}", f"p_{rule.kind}"
    return f"""list_filter(list_transform(range(1, len({m}) + 1), lambda i: {{
      'a': (list_sum(list_transform(list_slice({p}, 1, i), lambda x: length(x)))
         + coalesce(list_sum(list_transform(list_slice({m}, 1, i - 1), lambda x: length(x))), 0))::BIGINT,
      'w': length({m}[i]), 'h': length({g}[i])}}), lambda s: s.h >= {rule.least})"""


def _matches_sql(rule: secret_scan.Rule) -> str:
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern.replace("'", "''")
    return (f"regexp_extract_all(t, '{pattern}') AS m_{rule.kind}, regexp_extract_all(t, '{pattern}', {rule.group}) AS g_{rule.kind}, "
            f"string_split_regex(t, '{pattern}') AS p_{rule.kind}")


def _listed_sql(rules) -> str:
    parts = " || ".join(f"list_transform(k_{r.kind}, lambda s: {{'a': s.a, 'o': {i}, 'e': s.a + s.w, 'k': '{r.kind}'}})" for i, r in enumerate(rules))
    return f"coalesce(array_to_string(list_transform(list_sort({parts}), lambda s: s.k || ':' || s.a || ':' || s.e), ','), '')"


OP5_SQL = f"""
WITH matched AS MATERIALIZED (
  SELECT doc_id, {', '.join(map(_matches_sql, secret_scan.RULES))}
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), found AS MATERIALIZED (
  SELECT doc_id, {', '.join(f'{_spans_sql(r)} AS k_{r.kind}' for r in secret_scan.RULES)} FROM matched
)
SELECT doc_id, len(k_assign)::BIGINT AS n_assign, len(k_access)::BIGINT AS n_access, len(k_hex)::BIGINT AS n_hex,
  sha256({_listed_sql([r for r in secret_scan.RULES if r.base])}) AS base_sha256, {_listed_sql(secret_scan.RULES)} AS spans
FROM found
"""


@query("op5_secrets", OP5_SQL)
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    base = [r for r in secret_scan.RULES if r.base]
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
                        secret_scan.listed(secret_scan.RULES).alias("spans"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0), range(1, len(w) - n + 2) r(i)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM grams), range(1, len(w) - n + 2) r(i)
), met AS (
  SELECT p.doc_id, p.n, p.i, g.item_id FROM places p JOIN grams g ON p.n = g.n AND p.gram = g.gram
), hit AS (
  SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM met) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query("op10_decontaminate", OP10_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is benchmark text."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _part(n: int):
    """Which of n parts a document falls in."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is toxic, by a classifier that has not seen one part in five of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(_part(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(_part(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, by a model that has not seen one part in four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(_part(4) != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_part(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every twentieth row."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


# The vocabulary is public and read from where its package keeps it; 50256 is the id its makers use for the end of a document.
VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat token files of the whole table."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_counts.write_token_files(docs, path, Path(public_tokenizers.path(VOCABULARY)).read_bytes(), public_tokenizers.PATTERN, END_OF_DOCUMENT)
    blocks, order = token_counts.read_token_files(spark, path)
    counted = token_counts.scan(blocks, END_OF_DOCUMENT)
    return counted.join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h, md5(array_to_string(w[i:i + 49], ' ')) AS m FROM d, range(1, len(w) - 48) r(i)
), firsts AS (
  SELECT h, m, min(doc_id) AS lowest FROM windows GROUP BY h, m
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h, m) WHERE lowest < doc_id
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op4_substring_dedup", OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that earlier documents have."""
    done = substring_dedup.remove_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), runs AS (
  SELECT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS run, count(*) AS n FROM d, range(1, greatest(1, len(w) - 4) + 1) r(i) WHERE len(w) > 0 GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(n) AS size FROM runs GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS shared FROM runs x JOIN runs y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes s ON a = s.doc_id JOIN sizes t ON b = t.doc_id WHERE shared / (s.size + t.size - shared) >= 0.8
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT root, b FROM reached JOIN ways ON node = a
)
SELECT node AS doc_id, min(root) AS class_id FROM reached GROUP BY node
"""


@query("op3_minhash", OP3_SQL)
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


# One edit or none: the lines are equal without their i-th character, or one is the other without a character.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), places AS (
  SELECT doc_id, i, lines[i] AS line FROM d, range(1, len(lines) + 1) r(i) WHERE length(lines[i]) >= 20
), firsts AS (
  SELECT line, min((doc_id, i)) AS spot FROM places GROUP BY line
), cuts AS (
  SELECT line, spot, i, md5(substr(line, 1, i - 1) || substr(line, i + 1)) AS code FROM firsts, range(1, length(line) + 1) r(i)
), near AS (
  SELECT DISTINCT x.line, x.spot, y.line AS other, y.spot AS other_spot FROM cuts x JOIN cuts y ON x.code = y.code AND x.i = y.i AND x.line <> y.line
  UNION SELECT x.line, x.spot, f.line, f.spot FROM cuts x JOIN (SELECT *, md5(line) AS code FROM firsts) f USING (code)
  UNION SELECT f.line, f.spot, x.line, x.spot FROM cuts x JOIN (SELECT *, md5(line) AS code FROM firsts) f USING (code)
), verdicts AS (
  SELECT line, count(*) AS links, bool_or(other_spot < spot) AS earlier FROM near GROUP BY line
), judged AS (
  SELECT p.doc_id, f.spot < (p.doc_id, p.i) AS copy, coalesce(earlier, false) AS earlier, coalesce(links, 0) AS links
  FROM places p JOIN firsts f USING (line) LEFT JOIN verdicts v USING (line)
), summed AS (
  SELECT doc_id, count(*) FILTER (copy OR earlier) AS n_removed, count(*) FILTER (NOT copy AND earlier) AS n_near, sum(links) AS links FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(links, 0)::BIGINT AS links
FROM d LEFT JOIN summed USING (doc_id)
"""


@query("op2_line_dedup", OP2_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document repeat an earlier line or are alike to one."""
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), formed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high, u,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:n], '') AS s FROM formed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""


@query("op11_fill_middle", OP11_SQL)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in two places and put into its form."""
    done = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


@query("op12_sharding")
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, and its place there."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS other_id, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), found AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM found WHERE rank <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest rows of other labels for the nearest rows of the same label, of every hundredth row."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)
