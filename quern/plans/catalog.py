"""All queries of the library by name over the supplied tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.numbers import rounded
from quern.operators import classification, detection, documents, layout, long_signals, openset, ordered, signals, tracker, transcripts, verification
from quern.plans import tables as t
from quern.sources import records
from quern.streaming import levels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


LABELLED = "samples AS (SELECT CAST(quality AS VARCHAR) AS y_true, CASE WHEN n_chars >= 1000 THEN '1' ELSE '0' END AS y_pred FROM labels JOIN documents USING (doc_id))"
PER_CLASS = f"""{LABELLED}, classes AS (SELECT y_true AS label FROM samples UNION SELECT y_pred FROM samples),
 n AS (SELECT label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true = label) AS support, count(*) FILTER (y_pred = label) AS guessed FROM classes CROSS JOIN samples GROUP BY label),
 pr AS (SELECT label, support, CASE WHEN guessed = 0 THEN 0.0 ELSE tp::DOUBLE / guessed END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS r FROM n),
 prf AS (SELECT label, round_even(p, 6) AS "precision", round_even(r, 6) AS recall, round_even(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1, support FROM pr)"""


@query(f"WITH {LABELLED} SELECT round_even(avg((y_true = y_pred)::INT::DOUBLE), 6) AS accuracy FROM samples")
def accuracy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.accuracy(t.labelled(spark, sf_dir))


@query(f"WITH {LABELLED}, classes AS (SELECT y_true AS label FROM samples UNION SELECT y_pred FROM samples) SELECT a.label AS y_true, b.label AS y_pred, (SELECT count(*) FROM samples s WHERE s.y_true = a.label AND s.y_pred = b.label) AS n FROM classes a, classes b")
def confusion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.confusion(t.labelled(spark, sf_dir))


@query(f"WITH {PER_CLASS} SELECT * FROM prf")
def prf_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.per_class(t.labelled(spark, sf_dir))


@query(f"WITH {PER_CLASS} SELECT round_even(avg(f1), 6) AS macro_f1 FROM prf")
def macro_f1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.macro_f1(t.labelled(spark, sf_dir))


@query(f"WITH {PER_CLASS} SELECT (SELECT round_even(avg((y_true = y_pred)::INT::DOUBLE), 6) FROM samples) AS accuracy, (SELECT round_even(avg(f1), 6) FROM prf) AS macro_f1, (SELECT count(*) FROM prf) AS n_classes, (SELECT count(*) FROM samples) AS n")
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = classification.report(t.labelled(spark, sf_dir), dense=False)
    return r.select("accuracy", "macro_f1", F.size("per_class").cast("long").alias("n_classes"), F.aggregate("confusion", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"))


PAIRS = "pairs AS (SELECT event_type = 'error' AS is_pos, value AS score FROM events WHERE value IS NOT NULL), by_score AS (SELECT score AS v, count(*) FILTER (is_pos) AS np, count(*) FILTER (NOT is_pos) AS nn FROM pairs GROUP BY 1), totals AS (SELECT sum(np)::DOUBLE AS n_pos, sum(nn)::DOUBLE AS n_neg, min(v) AS low, max(v) AS high FROM by_score)"
RATES = "marks AS (SELECT v, sum(np) AS np, sum(nn) AS nn, max(m) AS m FROM (SELECT v, np, nn, 0 AS m FROM by_score UNION ALL SELECT t, 0, 0, 1 FROM ts) GROUP BY v), below AS (SELECT v, m, coalesce(sum(np) OVER w, 0)::DOUBLE AS pb, coalesce(sum(nn) OVER w, 0)::DOUBLE AS nb FROM marks WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), rates AS (SELECT v AS t, 1.0::DOUBLE - nb / n_neg AS fpr, pb / n_pos AS fnr FROM below, totals WHERE m = 1)"


@query(f"WITH {PAIRS}, b AS (SELECT *, coalesce(sum(nn) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM by_score) SELECT round_even(sum(np * (nb + nn / 2.0::DOUBLE))::DOUBLE / (sum(np)::DOUBLE * sum(nn)::DOUBLE), 6) AS auroc FROM b")
def auroc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.auroc(t.scored_pairs(spark, sf_dir))


@query("SELECT round_even(1.0::DOUBLE - count(*) FILTER (event_type <> 'error' AND value < 250)::DOUBLE / count(*) FILTER (event_type <> 'error'), 6) AS far, round_even(count(*) FILTER (event_type = 'error' AND value < 250)::DOUBLE / count(*) FILTER (event_type = 'error'), 6) AS frr, 250.0::DOUBLE AS threshold FROM events")
def far_frr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.far_frr(t.scored_pairs(spark, sf_dir), 250.0)


@query(
    f"""WITH {PAIRS}, ts AS (SELECT DISTINCT t FROM (SELECT CASE WHEN i = 2000 THEN high + 1.0::DOUBLE ELSE (low - 1.0::DOUBLE) + i * (((high + 1.0::DOUBLE) - (low - 1.0::DOUBLE)) / 2000) END AS t FROM totals, range(2001) r(i) UNION ALL SELECT v FROM by_score)), {RATES},
 d AS (SELECT *, fpr - fnr AS diff, lag(t) OVER (ORDER BY t) AS t0, lag(fpr - fnr) OVER (ORDER BY t) AS d0, max(t) OVER () AS last FROM rates),
 best AS (SELECT * FROM d ORDER BY abs(diff), t LIMIT 1),
 chosen AS (SELECT CASE WHEN t0 IS NOT NULL AND t < last AND d0 * diff <= 0 AND diff <> 0 THEN t0 - d0 * (t - t0) / (diff - d0) ELSE t END AS t FROM best)
 SELECT round_even((1.0::DOUBLE - sum(CASE WHEN v < t THEN nn ELSE 0 END)::DOUBLE / sum(nn)::DOUBLE + sum(CASE WHEN v < t THEN np ELSE 0 END)::DOUBLE / sum(np)::DOUBLE) / 2, 6) AS eer, round_even(t, 6) AS threshold FROM by_score, chosen GROUP BY t"""
)
def eer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.eer(t.scored_pairs(spark, sf_dir))


@query(
    f"""WITH {PAIRS}, ordered AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM pairs),
 qs AS (SELECT CASE WHEN i = 39 THEN 0.999::DOUBLE ELSE 0.001::DOUBLE + i * (0.998::DOUBLE / 39) END AS q FROM range(40) r(i)),
 h AS (SELECT q, floor(q * (n - 1)) AS lo, q * (n - 1) - floor(q * (n - 1)) AS part FROM qs, (SELECT count(*)::DOUBLE AS n FROM pairs)),
 ts AS (SELECT DISTINCT a.score + (coalesce(b.score, a.score) - a.score) * part AS t FROM h JOIN ordered a ON a.k = lo LEFT JOIN ordered b ON b.k = lo + 1), {RATES},
 once AS (SELECT round_even(fpr, 6) AS fpr, round_even(fnr, 6) AS fnr, min(t) AS t FROM rates GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY t)::INT AS point, fpr, fnr FROM once"""
)
def det_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.det_points(t.scored_pairs(spark, sf_dir))


OPEN = "s AS (SELECT event_type AS y_true, list_extract(['view', 'click', 'purchase', 'error'], (user_id % 4 + 1)::INT) AS y_pred, value AS score FROM events), lim AS (SELECT min(score) AS low, max(score) + 1e-9::DOUBLE AS high, count(*) FILTER (y_true <> 'signup') AS n_known, count(*) AS n_all FROM s), grid AS (SELECT CASE WHEN i = 99 THEN high ELSE low + i * ((high - low) / 99) END AS threshold, n_known, n_all FROM lim, range(100) r(i)), c AS (SELECT threshold, n_known, n_all, count(*) FILTER (score >= threshold AND y_true <> 'signup' AND y_true = y_pred) AS tpi, count(*) FILTER (score >= threshold AND (y_true = 'signup' OR y_true <> y_pred)) AS fpi FROM grid CROSS JOIN s GROUP BY ALL), curve AS (SELECT *, CASE WHEN tpi + fpi = 0 THEN 0.0 ELSE tpi::DOUBLE / (tpi + fpi) END AS oscr FROM c)"


@query(f"WITH {OPEN} SELECT round_even(threshold, 6) AS threshold, round_even(tpi::DOUBLE / n_known, 6) AS tpi_rate, round_even(fpi::DOUBLE / n_all, 6) AS fpi_rate, round_even(oscr, 6) AS oscr, n_known, n_all - n_known AS n_unknown FROM curve")
def oscr_curve_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = openset.oscr_curve(t.open_samples(spark, sf_dir), "signup")
    return c.withColumn("threshold", rounded("threshold")).withColumn("oscr", rounded("oscr"))


@query(f"WITH {OPEN} SELECT round_even(oscr, 6) AS oscr, round_even(threshold, 6) AS threshold, n_known, n_all - n_known AS n_unknown FROM curve ORDER BY curve.oscr DESC, curve.threshold LIMIT 1")
def oscr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openset.oscr(t.open_samples(spark, sf_dir), "signup")


@query("SELECT round_even(avg((l_linenumber <= 1)::INT::DOUBLE), 6) AS rank1, round_even(avg((l_linenumber <= 5)::INT::DOUBLE), 6) AS rank5 FROM lineitem")
def rank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.rank_accuracy(t.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("rank")))


CELLS = "cells AS (SELECT doc_id AS pos, 'quality' AS class, quality AS y, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'toxic', toxic, 1 - (n_chars % 1000) / 1000.0::DOUBLE FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, sum(y) OVER w AS hits, row_number() OVER w AS seen FROM cells WINDOW w AS (PARTITION BY class ORDER BY score DESC, pos)), per AS (SELECT class, round_even(sum(CASE WHEN y = 1 THEN hits::DOUBLE / seen END) / nullif(sum(y), 0)::DOUBLE, 6) AS ap, round_even(coalesce(2.0::DOUBLE * count(*) FILTER (y = 1 AND score >= 0.5) / nullif(2 * count(*) FILTER (y = 1 AND score >= 0.5) + count(*) FILTER (y = 0 AND score >= 0.5) + count(*) FILTER (y = 1 AND score < 0.5), 0), 0.0), 6) AS f1 FROM r GROUP BY class)"


@query(f"WITH {CELLS} SELECT * FROM per")
def sed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.per_class(t.detections(spark, sf_dir))


@query(f"WITH {CELLS} SELECT round_even(avg(ap), 6) AS map FROM per")
def sed_map_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.mean_ap(t.detections(spark, sf_dir))


@query("WITH p AS (SELECT p_name AS r, replace(replace(p_name, 'a', ''), 'e', 'o') AS h FROM part) SELECT round_even(sum(levenshtein(trim(r), trim(h)))::DOUBLE / sum(length(trim(r))), 6) AS rate, sum(levenshtein(trim(r), trim(h)))::BIGINT AS errors, sum(length(trim(r)))::BIGINT AS total_tokens FROM p")
def cer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.table(spark, sf_dir, "part")
    return transcripts.error_rate(p.select(F.col("p_name").alias("ref"), F.expr("replace(replace(p_name, 'a', ''), 'e', 'o')").alias("hyp")), "cer")


@query(
    """WITH p AS (SELECT o_orderkey AS k, string_split(replace(o_orderpriority, '-', ' '), ' ') AS r, string_split(replace(replace(o_orderpriority, '1-', '') || '-' || o_orderstatus, '-', ' '), ' ') AS h FROM orders),
 w AS (SELECT *, list_distinct(list_concat(r, h)) AS v FROM p),
 e AS (SELECT levenshtein(list_aggregate(list_transform(r, lambda x: chr((65 + list_position(v, x))::INT)), 'string_agg', ''), list_aggregate(list_transform(h, lambda x: chr((65 + list_position(v, x))::INT)), 'string_agg', '')) AS e, len(r) AS n FROM w)
 SELECT round_even(sum(e)::DOUBLE / sum(n), 6) AS rate, sum(e)::BIGINT AS errors, sum(n)::BIGINT AS total_tokens FROM e"""
)
def wer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders")
    blank = lambda c: F.replace(c, F.lit("-"), F.lit(" "))
    return transcripts.error_rate(o.select(blank(F.col("o_orderpriority")).alias("ref"), blank(F.concat(F.replace("o_orderpriority", F.lit("1-"), F.lit("")), F.lit("-"), "o_orderstatus")).alias("hyp")), "wer")


@query()
def wer_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("ref")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return transcripts.error_rate(a.join(b, ["conv_id", "turn"]), "wer")


SIGNALS = "x AS (SELECT user_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS len, (value / 500)::FLOAT::DOUBLE AS v FROM events), f AS (SELECT path, CASE WHEN len < 5 THEN 0 ELSE i // 5 END AS frame, sqrt(sum(v * v) / count(*)) AS rms FROM x WHERE len < 5 OR i < 5 * (len // 5) GROUP BY ALL)"


@query(f"WITH {SIGNALS} SELECT path, frame::INT AS frame, round_even(rms, 6) AS rms FROM f")
def frame_rms_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.sample_frames(t.user_samples(spark, sf_dir)).withColumn("rms", rounded("rms"))


@query(
    f"""WITH {SIGNALS}, s AS (SELECT path, len / 100.0::DOUBLE AS duration, max(abs(v)) AS peak, avg((abs(v) >= 0.9::DOUBLE)::INT::DOUBLE) AS c9, avg((abs(v) >= 0.99)::INT::DOUBLE) AS clip FROM x GROUP BY path, len),
 q AS (SELECT s.path, duration, peak, clip, avg((rms < greatest(0.01 * peak, 1e-5))::INT::DOUBLE) AS silence, avg(rms) AS mean FROM s JOIN f USING (path) GROUP BY ALL)
 SELECT path, round_even(duration, 3) AS duration, round_even(peak, 4) AS peak, round_even(clip, 5) AS clip_ratio, round_even(silence, 3) AS silence_ratio, round_even(mean, 5) AS mean_rms, nullif(array_to_string(list_filter([CASE WHEN clip > 0.01 THEN 'clipping' END, CASE WHEN silence > 0.8 THEN 'high-silence' END, CASE WHEN duration < 0.2 THEN 'too-short' END, CASE WHEN duration > 120 THEN 'too-long' END, CASE WHEN peak = 0 THEN 'all-zero' END], lambda x: x IS NOT NULL), ','), '') AS flags FROM q"""
)
def quality_flags_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.sample_quality(t.user_samples(spark, sf_dir)).withColumn("flags", F.array_join("flags", ","))


@query("WITH n AS (SELECT count(*) / 100.0::DOUBLE AS v FROM events GROUP BY user_id), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM n) SELECT share::DOUBLE AS share, v AS value FROM o, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) q(share) WHERE k = least(floor(n * share), n - 1)")
def duration_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.lower_quantiles(t.table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") / 100).alias("d")), "d")


@query("SELECT l_linenumber AS sr, count(*) AS n FROM lineitem GROUP BY 1")
def rate_histogram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.rate_histogram(t.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("sr")))


@query("WITH v AS (SELECT vec_id, i, sign(embedding[i]) AS s FROM embeddings, range(1, 65) r(i)), d AS (SELECT vec_id, abs(s - lag(s) OVER (PARTITION BY vec_id ORDER BY i)) AS d FROM v) SELECT vec_id::VARCHAR AS path, round_even(avg(d), 5) AS zcr FROM d GROUP BY vec_id")
def zcr_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.crossing_rate(t.vector_signals(spark, sf_dir))


SPECTRA = """v AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 63)) AS x FROM embeddings, range(1, 65) r(i)),
 f AS (SELECT vec_id, k, pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2) AS p FROM v, range(33) q(k) GROUP BY ALL),
 c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS up, sum(p) OVER (PARTITION BY vec_id) AS total FROM f)"""


@query(f"WITH {SPECTRA} SELECT vec_id::VARCHAR AS path, 0 AS frame, round_even(sum(k * p) / sum(p), 4) AS centroid, (min(k) FILTER (up >= 0.85 * total))::DOUBLE AS rolloff, arg_max(k, p)::DOUBLE AS peak, (min(k) FILTER (up >= 0.95 * total) - min(k) FILTER (up >= 0.05 * total))::DOUBLE AS band FROM c GROUP BY vec_id")
def dft_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.spectra(t.vector_signals(spark, sf_dir), 64, 64).withColumn("centroid", rounded("centroid", 4))


SERIES = "x AS (SELECT user_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, (value / 500)::FLOAT::DOUBLE AS v FROM events)"


@query(f"WITH {SERIES}, d AS (SELECT path, v, abs(sign(v) - sign(lag(v) OVER (PARTITION BY path ORDER BY i))) AS d FROM x) SELECT path, round_even(count(*) / 100.0::DOUBLE, 3) AS duration_s, round_even(20 * log10(sqrt(avg(v * v)) + 1e-12), 2) AS rms_db, round_even(avg(d), 5) AS zcr FROM d GROUP BY path")
def levels_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_signals.features(t.user_samples(spark, sf_dir), ("duration", "zcr")).select("path", "duration_s", "rms_db", "zcr")


@query()
def features_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_signals.features(t.user_samples(spark, sf_dir).withColumn("sr", F.lit(16000)), signals.FEATURES)


@query()
def converted_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = long_signals.digests(long_signals.wav_parts(long_signals.converted(t.user_samples(spark, sf_dir), sr=80, normalize=True)))
    return files.select("path", F.lit(80).alias("sr"), F.expr("(n_bytes - 44) div 2").cast("int").alias("n"), F.col("sha256").alias("wav_sha256"))


@query("SELECT user_id::VARCHAR AS path, 80 AS sr, ceil(count(*) * 4 / 5.0)::BIGINT AS frames, 44 + 2 * ceil(count(*) * 4 / 5.0)::BIGINT AS n_bytes FROM events GROUP BY 1")
def converted_lengths_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the files that ``converted_users`` hashes, from the blocks that they are written in."""
    parts = long_signals.converted(t.user_samples(spark, sf_dir), sr=80)
    size = parts.groupBy("path").agg(F.max("sr").alias("sr"), F.sum("frames").alias("frames"), F.sum(F.octet_length("pcm")).alias("_n"))
    return size.select("path", "sr", "frames", (F.col("_n") + 44).alias("n_bytes"))


@query("SELECT user_id, unnest([0.05, 0.5, 0.95])::DOUBLE AS share, round_even(unnest(quantile_cont(value, [0.05, 0.5, 0.95])), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def quantiles_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of each user's values, however many one user has."""
    counts = t.table(spark, sf_dir, "events").groupBy("user_id", "value").agg(F.count("*").alias("n"))
    return ordered.order_statistics(counts, ["user_id"], "value", "n", [0.05, 0.5, 0.95]).withColumn("value", rounded("value"))


@query("WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n FROM k GROUP BY key ORDER BY n DESC, min(event_id) LIMIT 8")
def metric_keys_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.metric_keys(t.user_records(spark, sf_dir))


@query("SELECT user_id || '-' || event_type AS name, strftime(ts, '%Y-%m-%d') AS split, count(*) AS runs, count(DISTINCT json_extract_string(props, '$.k')) AS results FROM events GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT json_extract_string(props, '$.k')) > 1")
def duplicate_runs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.duplicate_runs(t.user_records(spark, sf_dir))


@query("SELECT left(sha256(string_agg(doc_id::VARCHAR || '|' || n_chars::VARCHAR || '|' || source, chr(10) ORDER BY doc_id::VARCHAR || '|' || n_chars::VARCHAR || '|' || source)), 16) AS sha256, count(*) AS n_files, 'stat-fingerprint' AS mode FROM documents")
def fingerprint_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.fingerprint(t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("source").alias("modified")))


TREE = """l AS (SELECT ('0x' || left(sha256(doc_id::VARCHAR), 8))::BIGINT >> 16 AS r, sha256(doc_id::VARCHAR || '|' || n_chars::VARCHAR || '|' || source) AS h FROM documents),
 t0 AS (SELECT r, sha256(string_agg(h, chr(10) ORDER BY h)) AS hash, count(*) AS n FROM l GROUP BY r),
 t1 AS (SELECT r >> 4 AS r, sha256(string_agg(hash, chr(10) ORDER BY r)) AS hash, sum(n)::BIGINT AS n FROM t0 GROUP BY r >> 4),
 t2 AS (SELECT r >> 4 AS r, sha256(string_agg(hash, chr(10) ORDER BY r)) AS hash, sum(n)::BIGINT AS n FROM t1 GROUP BY r >> 4),
 t3 AS (SELECT r >> 4 AS r, sha256(string_agg(hash, chr(10) ORDER BY r)) AS hash, sum(n)::BIGINT AS n FROM t2 GROUP BY r >> 4),
 t4 AS (SELECT r >> 4 AS r, sha256(string_agg(hash, chr(10) ORDER BY r)) AS hash, sum(n)::BIGINT AS n FROM t3 GROUP BY r >> 4)"""


@query(f"WITH {TREE} SELECT 0 AS level, r AS range, hash, n FROM t0 UNION ALL SELECT 1, * FROM t1 UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 3, * FROM t3 UNION ALL SELECT 4, * FROM t4")
def fingerprint_tree_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree over a listing of any size, whose changed ranges alone need hashing again."""
    return records.fingerprint_levels(t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("source").alias("modified")))


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS text FROM pages")
def strip_tags_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", text.without_tags("html").alias("text"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<title>(.*?)</title>', chr(10) || chr(10) || '## \1' || chr(10), 'gs'), '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM pages")
def article_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", text.article_text("html").alias("text"))


@query("SELECT page_id, array_to_string(CASE WHEN page_id % 3 = 0 THEN ['https://hal.science/' || page_id, 'https://hal.science/' || page_id || '/document'] WHEN page_id % 3 = 1 THEN ['https://pmc.ncbi.nlm.nih.gov/' || page_id || '/', 'https://pmc.ncbi.nlm.nih.gov/' || page_id || '/pdf/'] ELSE [url] END, ' ') AS urls FROM pages")
def url_forms_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t.table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://hal.science/"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/"), "page_id", F.lit("/"))).otherwise(F.col("url"))
    return p.select("page_id", F.array_join(text.url_forms(url), " ").alias("urls"))


@query("SELECT c_custkey, '10.1038/s' || c_custkey AS doi, 'https://www.nature.com/articles/s' || c_custkey || '.pdf' AS url FROM customer")
def doi_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "customer").select("c_custkey", text.strict_doi(F.concat(F.lit(" https://DOI.org/10.1038/s"), F.col("c_custkey").cast("string"))).alias("doi"))
    return c.select("c_custkey", "doi", F.element_at(text.publisher_urls("doi"), 1).alias("url"))


@query(
    """WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS k, c_custkey % 8 AS m FROM customer)
 SELECT c_custkey, CASE m WHEN 0 THEN 'https://link.springer.com/content/pdf/10.1007/s' || k || '.pdf' WHEN 1 THEN 'https://www.nature.com/articles/s' || k || '.pdf' WHEN 2 THEN 'https://www.pnas.org/doi/pdf/10.1073/pnas.' || k
  WHEN 3 THEN 'https://onlinelibrary.wiley.com/doi/pdfdirect/10.1002/w' || k || '?download=true' WHEN 4 THEN 'https://dl.acm.org/doi/pdf/10.1145/' || k || '.9' WHEN 5 THEN 'https://peerj.com/articles/' || CASE WHEN c_custkey % 16 = 5 THEN 'cs-' ELSE '' END || k || '.pdf'
  WHEN 6 THEN CASE WHEN length(k) >= 2 THEN 'https://www.sciencedirect.com/science/article/pii/S0000000' || k || '/pdfft?isDTMRedir=true&download=true' ELSE '' END ELSE 'https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber=' || k END AS urls,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://arxiv.org/pdf/' || k || 'v2' END AS arxiv FROM c"""
)
def publisher_urls_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every publisher's rule in turn; two of them go by the first alternative id that fits, if one does."""
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 8
    forms = ("10.1007/S{}", "10.1038/s{}", "10.1073/pnas.{}", "10.1002/w{}", "10.1145/{}.9", None, "10.1016/j.x.{}", "10.1109/access.{}")
    made = lambda form: F.concat(*[F.lit(x) for x in form.split("{}")[:1]], k, *[F.lit(x) for x in form.split("{}")[1:]])
    doi = F.when(F.col("c_custkey") % 16 == 5, made("10.7717/peerj-cs.{}")).when(m == 5, made("10.7717/peerj.{}"))
    for at, form in enumerate(forms):
        doi = doi.when(m == at, made(form)) if form else doi
    ids = F.array(F.lit("10.1016/j.not"), F.lit("short"), F.concat(F.lit("S0000000"), k), k)
    c = t.table(spark, sf_dir, "customer").select("c_custkey", doi.alias("doi"), ids.alias("ids"), F.when(F.col("c_custkey") % 3 == 0, made("10.48550/ARXIV.{}v2")).alias("preprint"))
    return c.select("c_custkey", F.array_join(text.publisher_urls("doi", "ids"), " ").alias("urls"), text.arxiv_url("preprint").alias("arxiv"))


@query("WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ('a','an','the','of','in','for','and','with','on','to','via','by','from','using','based','study','towards')) AS w FROM part) SELECT p_partkey, left('Doe2020_' || array_to_string(w[1:3], '-'), 60) AS name FROM w")
def directory_names_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "part").select("p_partkey", text.directory_name(F.array(F.lit("Jane Doe")), F.lit(2020), "p_name").alias("name"))


TOKENS = r"t AS (SELECT doc_id, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), '`[^`]*`', ' ', 'g'), '[A-Za-z][A-Za-z0-9\-'']{2,}'))) AS token FROM documents)"


@query(f"WITH {TOKENS} SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL")
def token_counts_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return documents.token_counts(docs).select(F.col("path").alias("doc_id"), "token", "n")


PLAIN = ", ".join(f"'{w}'" for w in text.PLAIN_WORDS)


GRAMS = "{name} AS MATERIALIZED (SELECT DISTINCT {word}, substr({word}, i, 3) AS gram FROM (SELECT {word}, unnest(range(1, length({word}) - 1)) AS i FROM {table}))"


@query(
    f"""WITH {TOKENS}, b AS MATERIALIZED (SELECT DISTINCT token FROM t WHERE token NOT IN ({PLAIN})),
 terms AS MATERIALIZED (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]{{2,}}'))) AS term FROM benchmark),
 {GRAMS.format(name="bg", word="token", table="b")}, {GRAMS.format(name="tg", word="term", table="terms")},
 covered AS MATERIALIZED (SELECT DISTINCT token FROM bg JOIN tg USING (gram) WHERE contains(token, term) OR contains(term, token))
 SELECT token FROM b ANTI JOIN covered USING (token)"""
)
def token_gap_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = documents.token_counts(docs).select(F.lit("all").alias("path"), "token").distinct()
    term = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z][A-Za-z0-9]{2,})"), F.lit(1))).alias("term")
    terms = t.table(spark, sf_dir, "benchmark").select(F.lit("all").alias("path"), term)
    return documents.uncovered(found, terms).select("token")


@query(
    """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, (l_partkey % 300)::DOUBLE AS x, (l_suppkey * 7 % 500)::DOUBLE AS y, l_quantity AS q FROM lineitem),
 c AS (SELECT doc_id, n AS block, x AS x0, y + 100 AS y0, x + 200 AS x1, y + 120 AS y1 FROM l WHERE n % 2 = 0),
 r AS (SELECT doc_id, n AS region, x AS x0, y AS y0, x + 60 + q * 2 AS x1, y + 80 + q AS y1 FROM l WHERE n % 2 = 1),
 d AS (SELECT doc_id, region, block, CASE WHEN least(r.x1, c.x1) - greatest(r.x0, c.x0) < 10 THEN NULL WHEN c.y0 >= r.y1 - 8 THEN CASE WHEN c.y0 - r.y1 <= 260 THEN c.y0 - r.y1 + 0.5 END WHEN c.y1 <= r.y0 + 8 THEN CASE WHEN r.y0 - c.y1 <= 130 THEN r.y0 - c.y1 + 100.5 END WHEN (c.y1 >= r.y1 - 15 AND r.y1 - c.y0 <= greatest(30, 0.3 * (r.y1 - r.y0))) OR (c.y0 <= r.y0 + 15 AND c.y1 - r.y0 <= greatest(30, 0.3 * (r.y1 - r.y0))) THEN 0.0 END AS d FROM r JOIN c USING (doc_id))
 SELECT doc_id, region, block, d::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, region ORDER BY d, block) AS k FROM d WHERE d IS NOT NULL) WHERE k = 1"""
)
def caption_nearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, boxes, blocks = t.layout(spark, sf_dir)
    lines = t.table(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 1")
    x, y = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") * 7 % 500).cast("double")
    found = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("l_linenumber").alias("region"), x.alias("x0"), y.alias("y0"), (x + 60 + F.col("l_quantity") * 2).alias("x1"), (y + 80 + F.col("l_quantity")).alias("y1"))
    own = layout.assigned(found, layout.captions(blocks))
    return own.join(_fits(found, blocks), ["doc_id", "region"], "left_semi").select("doc_id", "region", "block", "distance")


def _fits(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regions that some caption fits without being widened."""
    heads = layout.captions(blocks)
    both = found.select("doc_id", "region", *[F.col(c).alias(f"r{c}") for c in layout.BOX]).join(heads.select("doc_id", *[F.col(c).alias(f"c{c}") for c in layout.BOX]), "doc_id")
    return both.where(layout.caption_distance("r", "c").isNotNull()).select("doc_id", "region").distinct()


@query()
def figures_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.figures(*t.layout(spark, sf_dir))


@query(
    """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS block, (8 + l_linenumber)::DOUBLE AS size, l_linenumber = 2 AS bold, CASE WHEN l_linenumber % 4 = 0 THEN 'Table ' ELSE 'Fig. ' END || l_linenumber || ' of a line' AS text FROM lineitem WHERE l_linenumber % 2 = 0),
 s AS (SELECT doc_id, list_extract(list_sort(list(size)), count(*) // 2 + 1) AS body FROM b GROUP BY doc_id),
 k AS (SELECT b.*, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS item FROM b JOIN s USING (doc_id) WHERE size >= 1.25 * body)
 SELECT doc_id, item::INT AS item, 0 AS page, '[Page 1 | ' || printf('%.1f', size) || 'pt] ' || text AS text FROM k WHERE item < 400"""
)
def outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.outline(t.layout(spark, sf_dir)[2])


@query("SELECT user_id::VARCHAR AS key, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(value) AS n, round_even(sqrt(avg(value * value)), 6) AS rms, max(abs(value)) AS peak FROM events GROUP BY ALL")
def windowed_rms_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", "value")
    return levels.windowed_rms(e).select("key", F.col("start").cast("timestamp_ntz").alias("start"), "n", rounded("rms").alias("rms"), "peak")
