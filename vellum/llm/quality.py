"""Quality rules and a hashed n-gram log-likelihood ratio, all as DataFrame expressions.

Unigrams and bigrams of lower-cased words fall into BUCKETS hash buckets. One pass counts the buckets over all documents
(raw) and, within it, over trusted documents (target). A document's score is the mean over its n-grams of
log p_target - log p_raw. p_raw has add-one smoothing, p_target a prior of PRIOR n-grams spread as p_raw, so a small target
pulls ratios to 0 and not below. As such a pull shrinks all scores, the threshold is no number of nats: a document is
rejected when it lies farther below the mean score of raw n-grams than -THRESHOLD times the distance by which target
n-grams lie above it. Both means follow from the counts, so a text is judged much alike in a small and a large table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 1 << 16
#: N-grams that the prior of the target counts as.
PRIOR = 100_000
#: Place under which a document is rejected; 0 is the mean score of raw n-grams, 1 that of target n-grams.
THRESHOLD = -1.0
#: Trusted ids (8 bytes each) up to which they are broadcast; more meet their documents in a shuffle.
BROADCAST_IDS = 1 << 21
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: bound to a lambda variable, which no rule of the optimizer unfolds."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(plain, " ", -1), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def lower_hashes(words: Column) -> Column:
    """For the ratio only; repeated windows are told apart by case."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def joined(hashes: Column, apart: int) -> Column:
    """The hash of each entry with the one `apart` places on; as many fewer entries. Doubling gives runs of 2, 4, 8 words."""
    n = F.size(hashes)
    later = F.slice(hashes, apart + 1, F.greatest(n - apart, F.lit(0)))
    return F.zip_with(F.slice(hashes, 1, F.greatest(n - apart, F.lit(0))), later, lambda a, b: F.xxhash64(a, b))


def windows(pairs: Column) -> Column:
    """The hash of each WINDOW (8) consecutive words, from those of 2 words."""
    return let(joined(pairs, 2), lambda fours: joined(fours, 4))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, each word once.

    Only texts with a repeated window go on: windows are sorted with their places, those beside an equal neighbour
    repeat, and each place in order adds as many words as the place before it hasn't covered.
    """

    def covered(ranked: Column) -> Column:
        beside = lambda x, k: F.coalesce(F.get(ranked, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, k + 1)["h"] == x["h"], F.lit(False))
        places = F.array_sort(F.transform(F.filter(ranked, beside), lambda x: x["i"]))
        seed = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, seed, lambda a, i: F.struct((a["total"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("total"), i.alias("last")))["total"]

    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ranked, covered)).otherwise(F.lit(0).cast("long"))


def bucket(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BUCKETS)).cast("int")


def measures(text: Column, ratio: Column) -> Column:
    """Struct of the base columns of a text and its score."""

    def mean(hashes: Column) -> Column:
        add = lambda a, h: a + F.get(ratio, bucket(h))
        return let(joined(hashes, 1), lambda pairs: F.aggregate(pairs, F.aggregate(hashes, F.lit(0.0), add), add) / (F.size(hashes) + F.size(pairs)))

    def of(words: Column, pairs: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            let(windows(pairs), n_repeat_words).alias("n_repeat_words"),
            F.when(F.size(words) > 0, let(lower_hashes(words), mean)).otherwise(F.lit(0.0)).alias("score"),
        )

    return let(words(text), lambda w: let(joined(word_hashes(w), 1), lambda p: of(w, p)))


def trusted_ids(labels: DataFrame, broadcast: int = BROADCAST_IDS) -> DataFrame:
    """Distinct doc_id (trusted_id) of all labelled rows with quality 1; marked for broadcast if there are at most `broadcast`."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()
    return F.broadcast(ids) if ids.limit(broadcast + 1).count() <= broadcast else ids


def weights(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ratio, an array of log p_target - log p_raw by bucket; raw_mean and target_mean, of an n-gram's ratio.

    Without trusted documents all are 0.
    """
    flagged = documents.select("doc_id", "text").join(trusted_ids(labels), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = let(lower_hashes(words(F.col("text"))), lambda h: F.concat(h, joined(h, 1)))
    grams = flagged.select(F.col("trusted_id").isNotNull().cast("long").alias("target"), F.explode(grams).alias("gram"))
    counts = grams.groupBy(bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    all_ = documents.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    rows = F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))))
    total = all_.agg(rows.alias("rows"), F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("n_target"))
    raw = lambda x: (x["raw"] + 1) / (F.col("n_raw") + BUCKETS)
    ratio = lambda x: F.log((x["target"] / raw(x) + PRIOR) / (F.col("n_target") + PRIOR))
    out = total.select("*", F.when(F.col("n_target") > 0, F.transform("rows", ratio)).otherwise(F.transform("rows", lambda x: F.lit(0.0))).alias("ratio"))
    mean = lambda share: F.aggregate(F.zip_with("rows", "ratio", lambda x, r: share(x) * r), F.lit(0.0), lambda a, v: a + v)
    return out.select("ratio", mean(raw).alias("raw_mean"), mean(lambda x: x["target"] / F.greatest("n_target", F.lit(1))).alias("target_mean"))


def _failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def _with_ratio(documents: DataFrame, labels: DataFrame, name: str, threshold: float) -> tuple[DataFrame, float]:
    """documents with the table of ratios, a scalar subquery, as a further column; and the least score that is kept.

    Name the column once in an expression, with let: then it is put in its place and not copied for each row.
    """
    found = weights(documents, labels).first()
    table = documents.sparkSession.createDataFrame([(found["ratio"],)], "ratio array<double>")
    least = found["raw_mean"] + threshold * (found["target_mean"] - found["raw_mean"])
    return documents.select("*", table.scalar().alias(name)), least


def judge_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, score, base_failed and kept of each row of documents (doc_id, text; others are not read).

    labels (doc_id, quality) name the trusted documents; unlabelled and null ones are raw only. Null and empty texts have
    no words, score 0 and fail the base. Repeated rows stay. The ratio is a table of BUCKETS numbers, sent to tasks as
    a scalar subquery.
    """
    text = F.col("text")
    found, least = _with_ratio(documents.select("doc_id", "text"), labels, "ratio", threshold)
    found = found.select(
        "doc_id",
        let(F.col("ratio"), lambda ratio: measures(text, ratio)).alias("m"),
        F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
    )
    out = found.select("doc_id", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.score")
    out = out.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def kept_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that judge_quality keeps, all columns, without a join.

    The condition is one expression that binds the measures: pushed below a projection they would be computed for each
    of its terms.
    """
    rows, least = _with_ratio(documents, labels, "vellum_ratio", threshold)
    good = lambda m: ~_failed(m["n_words"], m["n_repeat_words"]) & (m["score"] >= least)
    return rows.where(let(F.col("vellum_ratio"), lambda ratio: let(measures(F.col("text"), ratio), good))).select(*documents.columns)
