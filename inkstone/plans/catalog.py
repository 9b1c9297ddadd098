"""The queries over the driver's tables, and their SQL.

Lines of documents stand in for labels, a fixed corruption of them for predictions, and embeddings for scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, losses, scoring
from ..operators import alignment, augmentation, batch_scoring, evaluation, sampling
from ..sources import ingest, pixels, samples

#: Characters of a label at most, where the operator has such a limit: the length filter and the encoders of fixed width.
LONGEST = 100
ALPHABET = "abcdefghijklmnopqrstuvwxyz ,."

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if sql.startswith("WITH") else f"{WITH}{sql}"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, no, label): every line of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("no", "label"))


def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that the length filter leaves."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "label"))
    return lines.filter(F.char_length("label") <= LONGEST)


def corrupted(gt: Column) -> Column:
    kind = F.col("doc_id") % 4
    return F.when(kind == 0, gt).when(kind == 1, F.replace(gt, F.lit("e"), F.lit("a"))).when(kind == 2, F.substring(gt, F.lit(2), F.char_length(gt))).otherwise(F.replace(gt, F.lit("n"), F.lit("")))


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, no, gt, pred) in ASCII."""
    lines = labels(spark, sf_dir).select("doc_id", "source", "no", F.regexp_replace("label", r"[^\x00-\x7F]", "#").alias("gt"))
    return lines.withColumn("pred", corrupted(F.col("gt")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``guesses`` with their edit similarity, ned."""
    return evaluation.scored(guesses(spark, sf_dir))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, ids): token ids 0 to 3, one for each component."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 16), F.lit(4)).cast("int")).alias("ids"))


WITH = rf"""WITH label AS (
  SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS label FROM documents
), short_label AS (
  SELECT * FROM label WHERE length(label) <= {LONGEST}
), gt AS (
  SELECT *, regexp_replace(label, '[^\x00-\x7F]', '#', 'g') AS gt FROM label
), guess AS (
  SELECT *, CASE doc_id % 4 WHEN 0 THEN gt WHEN 1 THEN replace(gt, 'e', 'a') WHEN 2 THEN substring(gt, 2) ELSE replace(gt, 'n', '') END AS pred FROM gt
), pair AS (
  SELECT *, CASE WHEN gt = '' OR pred = '' THEN 0.0 ELSE 1 - levenshtein(pred, gt) / CAST(greatest(length(gt), length(pred)) AS DOUBLE) END AS ned FROM guess
), seq AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 16) AS INTEGER) & 3 FOR x IN embedding] AS ids FROM embeddings
), vec AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
)
"""


@query("SELECT source, count(*) AS n, round(100 * avg(CAST(gt = pred AS INTEGER)), 6) AS accuracy, round(sum(ned * length(gt)) / nullif(sum(length(gt)), 0), 6) AS norm_ed, CAST(sum(length(gt)) AS BIGINT) AS chars FROM pair GROUP BY source")
def eval_summary(spark, sf_dir):
    size = F.char_length("gt")
    return pairs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("gt") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.round(F.sum(F.col("ned") * size) / F.nullif(F.sum(size), F.lit(0)), 6).alias("norm_ed"), F.sum(size).alias("chars"))


@query("SELECT doc_id, no, round(ned, 6) AS ned FROM pair")
def normalized_edit_distance(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", "no", F.round("ned", 6).alias("ned"))


@query("SELECT doc_id, no, gt, pred FROM pair WHERE round(ned * 100, 6) <= 80")
def threshold_report(spark, sf_dir):
    return pairs(spark, sf_dir).filter(F.round(F.col("ned") * 100, 6) <= 80).select("doc_id", "no", "gt", "pred")


@query("SELECT CAST(least(floor(round(ned, 6) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM pair GROUP BY 1")
def ned_histogram(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy(F.least(F.floor(F.round("ned", 6) * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT ch, count(*) AS total FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def char_frequency(spark, sf_dir):
    return alignment.char_counts(table(spark, sf_dir, "documents"), "text")


@query("SELECT ch, total, correct, round(100.0 * correct / total, 6) AS accuracy FROM (SELECT g AS ch, count(*) AS total, count(*) FILTER (WHERE g = p) AS correct FROM (SELECT unnest(string_split(gt, '')) AS g, unnest(string_split(replace(gt, 'e', 'a'), '')) AS p FROM gt) WHERE g <> '' GROUP BY g)")
def char_accuracy(spark, sf_dir):
    gt = F.regexp_replace("label", r"[^\x00-\x7F]", "#")
    zipped = F.arrays_zip(codecs.chars(gt).alias("g"), codecs.chars(F.replace(gt, F.lit("e"), F.lit("a"))).alias("p"))
    both = labels(spark, sf_dir).select(F.inline(zipped).alias("g", "p"))
    counted = both.groupBy(F.col("g").alias("ch")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("g") == F.col("p")).alias("correct"))
    return counted.withColumn("accuracy", F.round(100 * F.col("correct") / F.col("total"), 6))


@query()
def char_alignment(spark, sf_dir):
    return alignment.char_report(guesses(spark, sf_dir), F.col("gt"), F.col("pred")).orderBy(F.desc("accuracy"), "ch")


@query("SELECT vec_id, coalesce(list_aggregate([substring('abc', ids[i], 1) FOR i IN range(1, len(ids) + 1) IF ids[i] <> 0 AND (i = 1 OR ids[i - 1] <> ids[i])], 'string_agg', ''), '') AS decoded FROM seq")
def ctc_greedy_decode(spark, sf_dir):
    return sequences(spark, sf_dir).select("vec_id", codecs.ctc_decode(F.col("ids"), "abc").alias("decoded"))


@query("SELECT vec_id, coalesce(array_to_string([i - 1 FOR i IN range(1, len(ids) + 1) IF ids[i] <> 0 AND (i = len(ids) OR ids[i + 1] <> ids[i])], ' '), '') AS places FROM seq")
def dedup_runs(spark, sf_dir):
    return sequences(spark, sf_dir).select("vec_id", F.array_join(codecs.last_of_runs(F.col("ids")), " ").alias("places"))


@query("SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best, round(1 / list_sum([exp(x - list_max(v)) FOR x IN v]), 6) AS confidence FROM vec")
def softmax_confidence(spark, sf_dir):
    x = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", scoring.argmax(x).alias("best"), F.round(F.array_max(scoring.softmax(x)), 6).alias("confidence"))


@query("SELECT vec_id, round(coalesce(list_product([1 - abs(x) / 100 FOR x IN v]), 0), 6) AS confidence FROM vec")
def confidence_product(spark, sf_dir):
    p = F.transform("embedding", lambda x: 1 - F.abs(x.cast("double")) / 100)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scoring.cumulative_product(p), 6).alias("confidence"))


@query("SELECT vec_id, round(list_sum([(x - list_min(v)) / (list_max(v) - list_min(v)) FOR x IN v]), 6) AS total FROM vec")
def min_max(spark, sf_dir):
    total = F.aggregate(scoring.min_max(F.col("embedding")), F.lit(0.0), lambda a, b: a + b)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


@query("SELECT vec_id, array_to_string([CAST(j = label AS INTEGER) FOR j IN range(0, 10)], '') AS hot FROM embeddings")
def one_hot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(scoring.one_hot(F.col("label"), 10), "").alias("hot"))


@query("SELECT vec_id, round(list_sum(v) + 16 * v[len(v)], 6) AS total FROM vec")
def edge_pad(spark, sf_dir):
    row = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(scoring.edge_pad(row, 80), F.lit(0.0), lambda a, b: a + b)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


@query("SELECT p_partkey, CAST(least(400, ceil(32.0 * p_size * 20 / (10 + p_partkey % 50))) AS INTEGER) AS width FROM part")
def resize_width(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scoring.resized_width(F.col("p_size") * 20, 10 + F.col("p_partkey") % 50, 32, 400).alias("width"))


@query("SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM vec) GROUP BY label, pos")
def ensemble_mean(spark, sf_dir):
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("pos", "x"))
    return long.groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


@query(f"SELECT doc_id, no, array_to_string([coalesce(nullif(strpos('{ALPHABET}', label[i]), 0), 0) FOR i IN range(1, length(label) + 1)] || [0 FOR i IN range(length(label), {LONGEST})], ' ') AS ids, length(label) AS length FROM short_label")
def ctc_encode_pad(spark, sf_dir):
    return short_labels(spark, sf_dir).select("doc_id", "no", F.array_join(codecs.ctc_encode(F.col("label"), ALPHABET, LONGEST), " ").alias("ids"), F.char_length("label").alias("length"))


@query(f"SELECT doc_id, no, array_to_string(CASE WHEN len([1 FOR i IN range(1, length(label) + 1) IF strpos('{ALPHABET}', label[i]) = 0]) > 0 THEN [0 FOR i IN range(0, {LONGEST} + 2)] ELSE [0] || [strpos('{ALPHABET}', label[i]) + 1 FOR i IN range(1, length(label) + 1)] || [1] || [0 FOR i IN range(length(label), {LONGEST})] END, ' ') AS ids FROM short_label")
def attn_encode_pad(spark, sf_dir):
    return short_labels(spark, sf_dir).select("doc_id", "no", F.array_join(codecs.attention_encode(F.col("label"), ALPHABET, LONGEST), " ").alias("ids"))


@query("SELECT doc_id, no, CASE WHEN instr(p, '[s]') > 0 THEN left(p, instr(p, '[s]') - 1) ELSE substring(p, 1, greatest(length(p) - 1, 0)) END AS pruned FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN label || '[s]xx' ELSE label END AS p FROM label)")
def attn_prune(spark, sf_dir):
    p = F.when(F.col("doc_id") % 2 == 0, F.concat("label", F.lit("[s]xx"))).otherwise(F.col("label"))
    return labels(spark, sf_dir).select("doc_id", "no", codecs.prune(p).alias("pruned"))


@query(f"SELECT doc_id, no FROM short_label WHERE regexp_full_match(lower(label), '[{ALPHABET}]*')")
def label_filter(spark, sf_dir):
    return short_labels(spark, sf_dir).filter(codecs.known(F.lower("label"), ALPHABET)).select("doc_id", "no")


@query(f"SELECT doc_id, no, regexp_replace(label, '[^{ALPHABET}]', '', 'g') AS label FROM label")
def strip_oov(spark, sf_dir):
    return labels(spark, sf_dir).select("doc_id", "no", codecs.strip_unknown(F.col("label"), ALPHABET).alias("label"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS idx FROM documents")
def dense_index(spark, sf_dir):
    return sampling.dense_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, CAST(sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS BIGINT) AS offset, CAST(length(text) AS BIGINT) AS length FROM documents")
def flat_offsets(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("length"))
    total = sampling.running_total(sizes, "doc_id", F.col("length"), "upto")
    return total.select("doc_id", (F.col("upto") - F.col("length")).alias("offset"), "length")


@query(f"SELECT doc_id, no, array_to_string([strpos('{ALPHABET}', label[i]) FOR i IN range(1, length(label) + 1)], ' ') AS ids, length(label) AS length FROM label")
def flat_encode(spark, sf_dir):
    return labels(spark, sf_dir).select("doc_id", "no", F.array_join(codecs.flat_ids(F.col("label"), ALPHABET), " ").alias("ids"), F.char_length("label").alias("length"))


# Where each label lies in the one vector of all ids, and what lies there.
@query(f"SELECT doc_id, no, CAST(sum(length(label)) OVER (ORDER BY doc_id, no) - length(label) AS BIGINT) AS offset, CAST(length(label) AS BIGINT) AS length, array_to_string([strpos('{ALPHABET}', label[i]) FOR i IN range(1, length(label) + 1)], ' ') AS ids FROM label")
def flat_vector(spark, sf_dir):
    lines = labels(spark, sf_dir).select("doc_id", "no", "label", F.concat_ws("-", *(F.lpad(c.cast("string"), 19, "0") for c in (F.col("doc_id"), F.col("no")))).alias("at"))
    return sampling.flat_vector(lines, "at", "label", ALPHABET).select("doc_id", "no", "offset", "length", F.array_join("ids", " ").alias("ids"))


@query("SELECT vec_id, coalesce(list_aggregate([['[GO]', '[s]', 'a', 'b'][i + 1] FOR i IN ids], 'string_agg', ''), '') AS decoded FROM seq")
def attn_decode(spark, sf_dir):
    return sequences(spark, sf_dir).select("vec_id", codecs.attention_decode(F.col("ids"), "ab").alias("decoded"))


@query("SELECT vec_id, round(list_min([x - list_max(v) - ln(list_sum([exp(y - list_max(v)) FOR y IN v])) FOR x IN v]), 6) AS least FROM vec")
def log_softmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_min(scoring.log_softmax(F.col("embedding"))), 6).alias("least"))


@query(r"""SELECT vec_id, gt, pred, round(confidence, 6) AS confidence, pred = gt AS exact, round(CASE WHEN gt = '' OR pred = '' THEN 0.0 ELSE 1 - levenshtein(pred, gt) / CAST(greatest(length(gt), length(pred)) AS DOUBLE) END, 6) AS ned FROM (
  SELECT vec_id, gt, list_product(p) AS confidence, coalesce(list_aggregate([substring('abc', ids[i], 1) FOR i IN range(1, len(ids) + 1) IF ids[i] <> 0 AND (i = 1 OR ids[i - 1] <> ids[i])], 'string_agg', ''), '') AS pred FROM (
    SELECT vec_id, substring('abcabcabcabcabc', label + 1, 6) AS gt, [list_position(l, list_max(l)) - 1 FOR l IN steps] AS ids, [1 / list_sum([exp(x - list_max(l)) FOR x IN l]) FOR l IN steps] AS p
    FROM (SELECT vec_id, label, [v[4 * t + 1 : 4 * t + 4] FOR t IN range(0, len(v) // 4)] AS steps FROM vec)))""")
def evaluate_logits(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    logits = vectors.select(F.col("vec_id").alias("sample_id"), F.posexplode(steps_of(4)).alias("t", "logit"))
    truth = vectors.select(F.col("vec_id").alias("sample_id"), F.substring(F.lit("abcabcabcabcabc"), F.col("label") + 1, F.lit(6)).alias("label"))
    rows = evaluation.evaluate(logits, truth, "abc")
    return rows.select(F.col("sample_id").alias("vec_id"), "gt", "pred", F.round("confidence", 6).alias("confidence"), "exact", F.round("ned", 6).alias("ned"))


def steps_of(width: int) -> Column:
    """A vector as scores: ``width`` classes a step."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / width).cast("int") - 1), lambda t: F.slice("embedding", width * t + 1, width))


# A fifth of the labels are longer than any alignment.
@query("""WITH RECURSIVE sample AS (
  SELECT vec_id, [[CAST(x AS DOUBLE) FOR x IN embedding[4 * t + 1 : 4 * t + 4]] FOR t IN range(0, len(embedding) // 4)] AS steps, [1 + (label + i) % 3 FOR i IN range(0, CASE WHEN vec_id % 5 = 0 THEN 20 ELSE 6 END)] AS ids FROM embeddings
), place AS (
  SELECT vec_id, len(ids) AS size, 2 * len(ids) + 1 AS n, [CASE WHEN s % 2 = 1 THEN 0 ELSE ids[s // 2] END FOR s IN range(1, 2 * len(ids) + 2)] AS z, [[exp(x - list_max(l)) / list_sum([exp(y - list_max(l)) FOR y IN l]) FOR x IN l] FOR l IN steps] AS p FROM sample
), front(vec_id, t, a) AS (
  SELECT vec_id, 1, [CASE WHEN s <= 2 THEN p[1][z[s] + 1] ELSE 0 END FOR s IN range(1, n + 1)] FROM place
  UNION ALL SELECT front.vec_id, t + 1, [(a[s] + coalesce(a[s - 1], 0) + CASE WHEN s > 2 AND z[s] <> 0 AND z[s] <> z[s - 2] THEN a[s - 2] ELSE 0 END) * p[t + 1][z[s] + 1] FOR s IN range(1, n + 1)] FROM front JOIN place ON front.vec_id = place.vec_id WHERE t < len(p)
)
SELECT vec_id, CAST(size AS INTEGER) AS size, round(CASE WHEN a[n] + a[n - 1] > 0 THEN -ln(a[n] + a[n - 1]) ELSE 0 END, 6) AS loss FROM front JOIN place USING (vec_id) WHERE t = len(p)""")
def ctc_loss(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.when(F.col("vec_id") % 5 == 0, 19).otherwise(5)), lambda i: (1 + (F.col("label") + i) % 3).cast("int"))
    samples_ = table(spark, sf_dir, "embeddings").select("vec_id", steps_of(4).alias("logits"), ids.alias("ids"))
    return samples_.select("vec_id", F.size("ids").alias("size"), F.round(losses.ctc_loss(F.col("logits"), F.col("ids")), 6).alias("loss"))


def head() -> tuple[np.ndarray, np.ndarray]:
    """A made-up head of four inputs and four classes."""
    d, k = np.mgrid[:4, :4]
    return ((3 * d + 5 * k) % 7 - 3) / 2, np.arange(4) / 8


# Five passes, each without a fifth of the steps; then decoding and confidence, as of any scores.
@query("""WITH step AS (
  SELECT vec_id, label, t, [CAST(x AS DOUBLE) FOR x IN embedding[4 * t + 1 : 4 * t + 4]] AS x, len([p FOR p IN range(5) IF CAST('0x' || substring(md5('11-' || p || '-' || vec_id || '-' || t), 1, 13) AS BIGINT) / 4503599627370496.0 >= 0.2]) / 5.0 AS kept
  FROM (SELECT *, unnest(range(0, len(embedding) // 4)) AS t FROM embeddings)
), logit AS (
  SELECT vec_id, label, t, [kept * list_sum([x[d + 1] * ((3 * d + 5 * k) % 7 - 3) / 2.0 FOR d IN range(4)]) + k / 8.0 FOR k IN range(4)] AS l FROM step
), best AS (
  SELECT vec_id, label, list(list_position(l, list_max(l)) - 1 ORDER BY t) AS ids, list_product(list(1 / list_sum([exp(y - list_max(l)) FOR y IN l]) ORDER BY t)) AS confidence FROM logit GROUP BY vec_id, label
)
SELECT vec_id, substring('abcabcabcabcabc', label + 1, 6) AS gt, coalesce(list_aggregate([substring('abc', ids[i], 1) FOR i IN range(1, len(ids) + 1) IF ids[i] <> 0 AND (i = 1 OR ids[i - 1] <> ids[i])], 'string_agg', ''), '') AS pred, round(confidence, 6) AS confidence FROM best""")
def score_batches(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "sample_id")
    logits = batch_scoring.score_batches(vectors.select("sample_id", F.col("embedding").alias("features")), head, steps=16, inputs=4, seed=11)
    truth = vectors.select("sample_id", F.substring(F.lit("abcabcabcabcabc"), F.col("label") + 1, F.lit(6)).alias("label"))
    rows = evaluation.evaluate(logits, truth, "abc")
    return rows.select(F.col("sample_id").alias("vec_id"), "gt", "pred", F.round("confidence", 6).alias("confidence"))


@query("SELECT vec_id, round(coalesce(list_sum([CASE WHEN (vec_id + t) % 4 = 0 THEN 0 ELSE ln(list_sum([exp(x) FOR x IN v[4 * t + 1 : 4 * t + 4]])) - v[4 * t + 1 + (vec_id + t) % 4] END FOR t IN range(0, len(v) // 4)]), 0), 6) AS total, CAST(len([1 FOR t IN range(0, len(v) // 4) IF (vec_id + t) % 4 <> 0]) AS BIGINT) AS n FROM vec")
def cross_entropy(spark, sf_dir):
    targets = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1), lambda t: ((F.col("vec_id") + t) % 4).cast("int"))
    found = table(spark, sf_dir, "embeddings").select("vec_id", losses.cross_entropy(steps_of(4), targets).alias("e"))
    return found.select("vec_id", F.round("e.total", 6).alias("total"), F.col("e.n").alias("n"))


@query("SELECT printf('label-%09d', doc_id) AS key, text AS value FROM documents UNION ALL SELECT printf('image-%09d', doc_id), md5(text) FROM documents UNION ALL SELECT 'num-samples', CAST(count(*) AS VARCHAR) FROM documents")
def kv_records(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("label"), F.md5("text").cast("binary").alias("image"))
    return samples.key_values(rows).select("key", F.decode("value", "UTF-8").alias("value"))


@query("SELECT doc_id AS idx, text AS label, md5(text) AS image FROM documents")
def kv_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("label"), F.md5("text").cast("binary").alias("image"))
    return samples.from_key_values(samples.key_values(rows)).withColumn("image", F.col("image").cast("string"))


@query("SELECT item_id, CAST(item_id AS VARCHAR) || '.png' AS image_path, text AS label FROM benchmark WHERE NOT contains(text, chr(9)) UNION ALL SELECT item_id, CAST(item_id AS VARCHAR) || '.png', '' FROM benchmark")
def ingest_tsv(spark, sf_dir):
    path = F.concat(F.col("item_id").cast("string"), F.lit(".png"))
    # Each row's own line, one with an empty label, one without a tab and one with too many.
    lines = F.explode(F.array(F.concat(path, F.lit("\t"), "text"), F.concat(path, F.lit("\t")), path, F.concat(path, F.lit("\tx\ty"))))
    return samples.split_fields(table(spark, sf_dir, "benchmark").select("item_id", lines.alias("value")))


@query("SELECT idx, line, CAST(line AS VARCHAR) || '.png' AS image_path, label FROM (SELECT row_number() OVER (ORDER BY doc_id) AS idx, doc_id AS line, source AS label FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 5 <> 2)")
def ingest_samples(spark, sf_dir):
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    # Some lines are malformed, and some files are missing.
    value = F.when(F.col("doc_id") % 7 == 3, path).otherwise(F.concat(path, F.lit("\t"), "source"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    files = docs.filter(F.col("doc_id") % 5 != 2).select(F.concat(F.lit("/base/"), path).alias("path"), path.cast("binary").alias("content"))
    kept, _ = samples.ingest(docs.select(F.col("doc_id").alias("line"), value.alias("value")), files, "/base")
    return kept.select("idx", "line", "image_path", "label")


@query("SELECT 'documents' AS source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark UNION ALL SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations")
def union_sources(spark, sf_dir):
    names = ("documents", "benchmark", "conversations")
    first, *rest = (table(spark, sf_dir, n).select(F.lit(n).alias("source"), "text") for n in names)
    for df in rest:
        first = first.unionByName(df)
    return first.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE i <= floor(n * 0.3)")
def prefix_fraction(spark, sf_dir):
    return sampling.prefix_fraction(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.3)


@query("SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 2) AS BIGINT) AS batch_id FROM documents")
def batch_quota(spark, sf_dir):
    return sampling.balanced_batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10, 0.25)


@query("""WITH RECURSIVE numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IN ('src0', 'src1')),
  dealt AS (SELECT doc_id, source, i - 1 AS place, n FROM numbered UNION ALL SELECT doc_id, source, place + n, n FROM dealt WHERE place + n < 3000)
SELECT doc_id, source, CAST(place // CASE source WHEN 'src0' THEN 8 ELSE 2 END AS BIGINT) AS batch_id FROM dealt WHERE place < 100 * CASE source WHEN 'src0' THEN 8 ELSE 2 END""")
def batch_restart(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.balanced_batches(docs, "source", "doc_id", 10, {"src0": 0.75, "src1": 0.25}, batches=100)


@query("SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 32) AS BIGINT) AS batch_id FROM events")
def mini_batches(spark, sf_dir):
    return sampling.mini_batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 32)


@query("SELECT event_id, event_type, value FROM (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE value > greatest(coalesce(before, -1), -1)")
def running_best(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return sampling.running_best(events, "event_type", ["ts", "event_id"], "value", F.to_date("ts")).select("event_id", "event_type", "value")


@query("SELECT event_type, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY event_type")
def running_average(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"))


@query("SELECT source, round(avg(length(text)), 6) AS mean_length, CAST(max(length(text)) AS BIGINT) AS max_length, count(*) AS n FROM documents GROUP BY source")
def label_stats(spark, sf_dir):
    size = F.char_length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg(size), 6).alias("mean_length"), F.max(size).cast("long").alias("max_length"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(least(floor((v - a) / step), 19) AS BIGINT) AS bin, round(a + least(floor((v - a) / step), 19) * step, 6) AS low, count(*) AS n FROM (SELECT length(label) AS v FROM label), (SELECT min(length(label)) AS a, (max(length(label)) - min(length(label))) / 20 AS step FROM label) GROUP BY ALL")
def length_histogram(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("label")).select(F.char_length("label").alias("v"))
    return alignment.histogram(sizes, "v", 20).withColumn("low", F.round("low", 6))


@query("SELECT p_brand, round(avg(p_size * 20 / CAST(10 + p_partkey % 50 AS DOUBLE)), 6) AS mean_aspect, round(max(p_size * 20 / CAST(10 + p_partkey % 50 AS DOUBLE)), 6) AS max_aspect, count(*) AS n FROM part GROUP BY p_brand")
def aspect_stats(spark, sf_dir):
    aspect = F.col("p_size") * 20 / (10 + F.col("p_partkey") % 50)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg(aspect), 6).alias("mean_aspect"), F.round(F.max(aspect), 6).alias("max_aspect"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3-' || doc_id)) AS place FROM documents")
def epoch_shuffle(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "documents").select("doc_id"), 3, "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY md5('0-' || doc_id) LIMIT 10")
def sample_ten(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy(sampling.seeded_order(0, F.col("doc_id"))).limit(10)


@query("SELECT doc_id, source FROM documents WHERE contains(source, 'c1') OR contains(source, '7')")
def source_select(spark, sf_dir):
    return samples.select_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["c1", "7"])


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey images, eight pixels wide: (vec_id, height, width, channels, pixels)."""
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(F.floor(x.cast("double") * 64), F.lit(256))), 2, "0"))
    size = {"height": F.floor(F.size("embedding") / 8).cast("int"), "width": F.lit(8), "channels": F.lit(1)}
    return table(spark, sf_dir, "embeddings").select("vec_id", *(c.alias(n) for n, c in size.items()), F.unhex(F.array_join(byte, "")).alias("pixels"))


PICTURE = """WITH picture AS (
  SELECT vec_id, len(embedding) // 8 AS height, [CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) & 255 FOR x IN embedding] AS v FROM embeddings
), pixel AS (
  SELECT vec_id, height, CAST((i - 1) // 8 AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x, v[i] AS v FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM picture)
)"""


@query(f"{PICTURE} SELECT vec_id, string_agg(printf('%02X', v), '' ORDER BY y, 7 - x) AS pixels FROM pixel GROUP BY vec_id")
def mirror_pixels(spark, sf_dir):
    return pixels.mirrored(pictures(spark, sf_dir)).select("vec_id", F.hex("pixels").alias("pixels"))


# Vectors as bitmap files: of five the first ends early, of seven the first has no area, of eleven the first is none.
@query("""SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE 'bmp' END AS format, CAST(CASE WHEN vec_id % 11 = 0 THEN NULL ELSE 8 END AS INTEGER) AS width,
  CAST(CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 0 ELSE len(embedding) // 8 END AS INTEGER) AS height,
  CASE WHEN vec_id % 11 = 0 THEN 'no image' WHEN vec_id % 7 = 0 THEN 'no area' WHEN vec_id % 5 = 0 THEN 'ends early' END AS reason FROM embeddings""")
def image_headers(spark, sf_dir):
    def little(n: Column) -> Column:
        """Four bytes, the lowest first."""
        digits = F.lpad(F.hex(n.cast("long")), 8, "0")
        return F.concat(*(F.substring(digits, 7 - 2 * i, 2) for i in range(4)))

    height = F.when(F.col("vec_id") % 7 == 0, F.lit(0)).otherwise(F.col("height"))
    size = F.lit(54) + F.octet_length("pixels")
    head = F.concat(F.when(F.col("vec_id") % 11 == 0, F.lit("4D42")).otherwise(F.lit("424D")), little(size), F.lit("00000000"), *(little(F.lit(n)) for n in (54, 40)), little(F.col("width")), little(height), F.repeat(F.lit("0"), 56))
    whole = F.concat(head, F.hex("pixels"))
    content = F.unhex(F.when(F.col("vec_id") % 5 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole))
    found = ingest.with_header(pictures(spark, sf_dir).select("vec_id", content.alias("content")))
    return found.select("vec_id", "header.*")


# Every pixel as a sum over a whole image, against two passes along rows and columns.
@query(f"""{PICTURE}, tap AS (
  SELECT size, "to", o, i, abs((i + 0.5 - (o + 0.5) * size / "to") / greatest(size / "to", 1)) AS d FROM (SELECT *, unnest(range(CAST(size AS BIGINT))) AS i FROM (SELECT *, unnest(range("to")) AS o FROM (SELECT CAST(8 AS DOUBLE) AS size, 12 AS "to" UNION SELECT DISTINCT CAST(height AS DOUBLE), 5 FROM picture)))
), kernel AS (
  SELECT size, "to", o, i, CASE WHEN d < 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 WHEN d < 2 THEN -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 ELSE 0 END AS w FROM tap
), weight AS (
  SELECT size, "to", o, i, w / sum(w) OVER (PARTITION BY size, "to", o) AS w FROM kernel
), made AS (
  SELECT vec_id, r.o AS y, c.o AS x, sum(v * r.w * c.w) AS v FROM pixel JOIN weight r ON r."to" = 5 AND r.size = height AND r.i = y JOIN weight c ON c."to" = 12 AND c.size = 8 AND c.i = x GROUP BY ALL
)
SELECT vec_id, string_agg(printf('%02X', CAST(least(greatest(floor(v + 0.5), 0), 255) AS INTEGER)), '' ORDER BY y, x) AS pixels FROM made GROUP BY vec_id""")
def bicubic_resize(spark, sf_dir):
    return pixels.resized(pictures(spark, sf_dir), 5, 12).select("vec_id", F.hex("pixels").alias("pixels"))


@query(f"""{PICTURE}, kernel AS (
  SELECT k, exp(-k * k / 2.0) / sum(exp(-k * k / 2.0)) OVER () AS w FROM range(-3, 4) r(k)
), made AS (
  SELECT p.vec_id, p.y, p.x, sum(q.v * a.w * b.w) AS v FROM pixel p CROSS JOIN kernel a CROSS JOIN kernel b JOIN pixel q ON q.vec_id = p.vec_id AND q.y = least(greatest(p.y + a.k, 0), p.height - 1) AND q.x = least(greatest(p.x + b.k, 0), 7) GROUP BY ALL
)
SELECT vec_id, string_agg(printf('%02X', CAST(floor(v + 0.5) AS INTEGER)), '' ORDER BY y, x) AS pixels FROM made GROUP BY vec_id""")
def blur_pixels(spark, sf_dir):
    blurred = augmentation.augmented(pictures(spark, sf_dir), "vec_id", 1, names=("GaussianBlur",), layers=1)
    return blurred.select("vec_id", F.hex("pixels").alias("pixels"))


@query()
def augment_pixels(spark, sf_dir):
    changed = augmentation.augmented(pictures(spark, sf_dir), "vec_id", epoch=3, seed=7)
    return changed.select("vec_id", "height", "width", F.hex("pixels").alias("pixels"))


@query("""WITH op(op, argument) AS (VALUES ('GaussianBlur', 2.0), ('MotionBlur', 10.0), ('GaussianNoise', 12.75), ('PoissonNoise', 20.0), ('SaltAndPepper', 0.05), ('Invert', 0.0), ('BorderCrop', 0.0), ('RandomResize', 0.0)
), turn AS (
  SELECT doc_id, op, argument, row_number() OVER (PARTITION BY doc_id ORDER BY substring(md5('7-3-' || doc_id || '-' || op), 1, 13), op) AS turn FROM documents CROSS JOIN op
)
SELECT doc_id, string_agg(op || ' ' || CAST(CAST(round(argument * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY turn) AS ops FROM turn WHERE turn <= 3 GROUP BY doc_id""")
def augment_schedule(spark, sf_dir):
    ops = augmentation.schedule(F.col("doc_id"), epoch=3, seed=7)
    named = F.transform(ops, lambda o: F.concat_ws(" ", o["op"], F.round(o["argument"] * 100).cast("long").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(named, ",").alias("ops"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(string_split(source || '-' || lang, '-')) AS name FROM documents) GROUP BY name")
def option_names(spark, sf_dir):
    names = samples.option_list(F.concat_ws("-", "source", "lang"))
    return table(spark, sf_dir, "documents").select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d_%H-%M-%S') AS stamp FROM events")
def run_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", codecs.run_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS INTEGER) AS step FROM events")
def resume_step(spark, sf_dir):
    tail = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", samples.checkpoint_step(F.concat(F.lit("best_model_"), tail, F.lit(".pth"))).alias("step"))
