"""Quality rules by robust multivariate outliers.

Every document becomes a vector of transformed text statistics. Per language and source the
centre and the scatter of the vectors are estimated by the minimum covariance determinant:
from a few deterministic starts around the medians, concentrate on the ``SUPPORT`` share of the
documents that lie nearest, step by step until the determinant stops falling; of the starts the
least determinant counts, and is reweighted once. With half as support, junk may be nearly half
of a group and has no part in the estimate. A document whose Mahalanobis
distance is beyond a chi-square quantile is rejected, as are documents that fail the base
rules (too short, or mostly repeated).

Every document of a group takes part in every step, as mergeable sums and quantile sketches
with partial aggregation, so a hot source is a few rows per task. Only the estimates, a row
per group, pass through Python. A source with fewer than ``MIN_GROUP`` usable documents in a
language shares an estimate with the other small sources of the language, a language that
is still too small with those of other languages; where even that is too small there is no
verdict, and what passes the base rules is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded, per_text, split_words, stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SUPPORT, MIN_GROUP = 0.5, 100
#: The logarithm of a determinant that falls by less has stopped falling (the cuts are approximate quantiles).
STILL = 1e-3
TAIL = 1e-5
#: What a text of average make-up brings into each ratio, in characters or words, so that short texts have no wild ratios.
PRIOR = 40.0
#: Transformed statistics and the least deviation each is taken to have; the shares of clean text hardly vary at all.
STATISTICS = {"word_length": 0.05, "symbols": 0.04, "capitals": 0.05, "marks": 0.05, "dup_lines": 0.12, "repeats": 0.12, "stutter": 0.06}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines", "n_stutter")

_KIND = np.zeros((3, 256), np.int64)
_KIND[0, [ord(c) for c in SYMBOLS]] = 1
_KIND[1, ord("A"):ord("Z") + 1] = 1
_KIND[2, [ord(c) for c in "!?;:()[]{}=+_/\\~^@\"'-"]] = 1


def _mixed(n: int, salt: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the index alone."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray, n_ids: int, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text the number of words in windows of ``window`` words that the text has at least twice.

    Windows are compared by 64-bit hashes of their word numbers, within a text only.
    """
    n = len(ids)
    if n < window:
        return np.zeros(len(offsets) - 1, np.int64)
    values, factors = _mixed(n_ids, 1)[ids], _mixed(window, 2) | np.uint64(1)
    hashes = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        hashes += values[k:n - window + 1 + k] * factors[k]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:n - window + 1] == text[window - 1:]
    hashes = hashes[inside] + _mixed(len(offsets) - 1, 3)[text[:n - window + 1][inside]]
    at = np.flatnonzero(inside)[pd.Series(hashes).duplicated(keep=False).to_numpy()]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return per_text(np.cumsum(cover[:-1]) > 0, offsets)


def _stutter(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 for each word that equals the word before it in its text."""
    same = np.zeros(len(ids), np.int64)
    same[1:] = ids[1:] == ids[:-1]
    firsts = offsets[:-1]
    same[firsts[firsts < len(ids)]] = 0
    return same


def count_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of a batch of texts; null texts count as empty."""
    texts = pc.fill_null(texts, "")
    words, offsets = split_words(texts)
    coded = words.dictionary_encode() if len(words) else None
    ids = coded.indices.to_numpy(zero_copy_only=False) if coded is not None else np.zeros(0, np.int64)
    raw = texts.cast(pa.large_binary())
    edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[edges[0]:edges[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    lines = pc.split_pattern(texts, "\n")
    line, of_text = lines.flatten(), pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)
    line, of_text = line.filter(real), of_text[real.to_numpy(zero_copy_only=False)]
    n = len(texts)
    n_lines = np.bincount(of_text, minlength=n)
    line_ids = line.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(line) else np.zeros(0, np.int64)
    distinct = np.unique(of_text * (len(line_ids) + 1) + line_ids) // (len(line_ids) + 1)
    return {
        "n_words": np.diff(offsets),
        "word_chars": per_text(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), offsets),
        "n_symbols": per_text(_KIND[0][data], edges),
        "n_dup_lines": n_lines - np.bincount(distinct.astype(np.int64), minlength=n),
        "n_repeat_words": repeated_words(ids, len(coded.dictionary) if coded is not None else 0, offsets),
        "n_capitals": per_text(_KIND[1][data], edges),
        "n_marks": per_text(_KIND[2][data], edges),
        "n_lines": n_lines,
        "n_stutter": per_text(_stutter(ids, offsets), offsets),
    }


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text."""
    kept = ["doc_id", "lang", "source"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in _COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            counts = count_batch(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(counts[c].astype(np.int64)) for c in _COUNTS], names=schema.names)

    return docs.select(*kept, "text").mapInArrow(run, schema)


def _vector() -> Column:
    """Logarithm of the mean word length, and square roots of smoothed shares."""
    chars, words = F.col("word_chars") + PRIOR, F.col("n_words") + PRIOR

    def share(count: str, of: Column) -> Column:
        return F.sqrt(F.col(count) / of)

    return F.array(
        F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) + 1), share("n_symbols", chars), share("n_capitals", chars),
        share("n_marks", chars), share("n_dup_lines", F.col("n_lines") + PRIOR / 4), share("n_repeat_words", words), share("n_stutter", words),
    )


def chi_square_quantile(p: float, dims: int) -> float:
    """By bisection of the regularised incomplete gamma function (a finite sum for even, erfc-based for odd degrees)."""
    def above(x: float) -> float:
        half = x / 2
        if dims % 2 == 0:
            term = total = math.exp(-half)
            for k in range(1, dims // 2):
                term *= half / k
                total += term
            return total
        term, total = math.sqrt(2 * x / math.pi) * math.exp(-half), math.erfc(math.sqrt(half))
        for k in range(1, (dims + 1) // 2):
            total += term
            term *= x / (2 * k + 1)
        return total

    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > 1 - p else (low, middle)
    return high


def _above(x: float, dims: int) -> float:
    """Chi-square probability above x."""
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_quantile(middle, dims) < x else (low, middle)
    return 1 - low


def _consistency(alpha: float, dims: int) -> float:
    """What the scatter of the nearest ``alpha`` of normal vectors is multiplied by."""
    return alpha / (1 - _above(chi_square_quantile(alpha, dims), dims + 2))


_ESTIMATE = "cell string, start int, mean array<double>, precision array<double>, det double"


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of array x by the arrays mean and precision (row by row)."""
    gap = [F.col("x")[i] - F.col("mean")[i] for i in range(p)]
    total = F.lit(0.0)
    for i in range(p):
        row = F.lit(0.0)
        for j in range(p):
            row = row + F.col("precision")[i * p + j] * gap[j]
        total = total + gap[i] * row
    return total


def _estimates(vectors: DataFrame, x: Column, factor: float, centred: bool = True) -> DataFrame:
    """Mean, inverse scatter and logarithm of its determinant per group and start of the arrays ``x``.

    ``centred`` is false for scatters around zero of vectors in units of ``mad`` from ``mean``.
    """
    p, floor = len(STATISTICS), np.array(list(STATISTICS.values()))
    sums = [F.sum(x[i]) for i in range(p)]
    products = [F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)]
    middle = [F.first(c).alias(c) if not centred else F.first(F.array().cast("array<double>")).alias(c) for c in ("mean", "scale")]
    moments = vectors.groupBy("cell", "start").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s"), F.array(*products).alias("ss"), *middle)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.triu_indices(p)
        for frame in frames:
            rows = []
            for cell, start, n, s, ss, middle, scale in frame.itertuples(index=False):
                mean, scatter = np.array(s) / n, np.zeros((p, p))
                scatter[at] = np.array(ss) / n
                scatter = np.triu(scatter) + np.triu(scatter, 1).T
                if centred:
                    scatter -= np.outer(mean, mean)
                else:  # the shape alone counts: its diagonal is that of the median deviations
                    size = np.sqrt(np.maximum(np.diag(scatter), 1e-9))
                    scatter, mean = scatter / np.outer(size, size) * np.outer(scale, scale), np.array(middle)
                # what a statistic varies in itself comes on top, so that no direction is without scatter
                scatter = scatter * factor + np.diag(floor ** 2)
                rows.append((cell, start, mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), np.linalg.slogdet(scatter)[1]))
            yield pd.DataFrame(rows, columns=["cell", "start", "mean", "precision", "det"])

    return stage(moments.mapInPandas(solve, _ESTIMATE), "estimates")


def _starts(vectors: DataFrame) -> DataFrame:
    """Estimates to start from, around the medians: median deviations alone, and with the correlations of the signs and of bounded deviations."""
    p, floors = len(STATISTICS), list(STATISTICS.values())
    middles = vectors.groupBy("cell").agg(F.array(*(F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(p))).alias("mean"))
    middles = stage(middles, "medians")
    spread = vectors.join(middles, "cell").groupBy("cell").agg(
        F.array(*(F.percentile_approx(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5, 1000) for i in range(p))).alias("mad"))
    scale = F.array(*(F.sqrt(F.pow(F.col("mad")[i] * 1.4826, 2) + floors[i] ** 2) for i in range(p)))
    scaled = stage(middles.join(spread, "cell").select("cell", "mean", scale.alias("scale")), "scales")
    z = F.array(*((F.col("x")[i] - F.col("mean")[i]) / F.col("scale")[i] for i in range(p)))
    placed = vectors.join(scaled, "cell").select("cell", "mean", "scale", z.alias("z"))
    length = F.greatest(F.sqrt(sum((F.col("z")[i] * F.col("z")[i] for i in range(p)), F.lit(0.0))), F.lit(1e-9))
    kinds = [F.array(*(F.col("z")[i] / F.col("length") for i in range(p))), F.array(*(F.tanh(F.col("z")[i]) for i in range(p)))]
    alone = F.array(*(F.lit(0.0) if i != j else 1 / F.pow(F.col("scale")[i], 2) for i in range(p) for j in range(p)))
    plain = scaled.select("cell", F.lit(0).alias("start"), "mean", alone.alias("precision"), F.lit(math.inf).alias("det"))
    others = placed.select("*", length.alias("length")).select("cell", "mean", "scale", F.posexplode(F.array(*kinds)).alias("start", "y")).withColumn("start", F.col("start") + 1)
    shaped = _estimates(others, F.col("y"), 1.0, centred=False).withColumn("det", F.lit(math.inf))
    return stage(plain.unionByName(shaped), "starts")


def _concentrated(vectors: DataFrame, support: float) -> DataFrame:
    """(cell, start, mean, precision) of the least determinant per cell, each start concentrated until its determinant stops falling."""
    p = len(STATISTICS)
    best = moving = _starts(vectors)
    while not moving.isEmpty():
        placed = vectors.join(moving, "cell").select("cell", "start", "x", _distance(p).alias("d"))
        cut = placed.groupBy("cell", "start").agg(F.percentile_approx("d", support, 1000).alias("cut"))
        near = placed.join(stage(cut, "cuts"), ["cell", "start"]).where(F.col("d") <= F.col("cut"))
        found = _estimates(near, F.col("x"), _consistency(support, p))
        moving = stage(found.join(best.select("cell", "start", F.col("det").alias("last")), ["cell", "start"]).where(F.col("det") < F.col("last") - STILL).drop("last"), "moving")
        best = stage(best.join(moving, ["cell", "start"], "left_anti").unionByName(moving), "best")
    least = best.groupBy("cell").agg(F.min(F.struct("det", "start", "mean", "precision")).alias("e"))
    return least.select("cell", F.lit(0).alias("start"), "e.mean", "e.precision")


def _cells(vectors: DataFrame, min_group: int) -> DataFrame:
    """Adds ``cell``, the group whose estimate judges a document, and ``teaches``, the groups whose estimates it enters.

    A group of its language and source judges itself; smaller ones pool within the language, then over languages. What
    is still too small is judged by an estimate over all documents of the language, then of the table. ``cell`` is null
    where the whole table is under ``min_group``.
    """
    def coded(c: str) -> Column:
        return F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), F.replace(F.col(c), F.lit("|"), F.lit("||"))))

    own = F.concat(coded("lang"), F.lit(" | "), coded("source"))
    sizes = vectors.groupBy(own.alias("own"), coded("lang").alias("of_lang")).agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes, "groups")
    small = sizes.where(F.col("n") < min_group)
    pooled = small.groupBy("of_lang").agg(F.sum("n").alias("n_lang"))
    rest = pooled.where(F.col("n_lang") < min_group).agg(F.sum("n_lang")).first()[0] or 0
    whole = sizes.groupBy("of_lang").agg(F.sum("n").alias("n_whole"))
    every = sizes.agg(F.sum("n")).first()[0] or 0
    pool = (
        F.when(F.col("n") >= min_group, F.col("own"))
        .when(F.col("n_lang") >= min_group, F.concat("of_lang", F.lit(" | *")))
        .when(F.lit(rest >= min_group), F.lit("*"))
    )
    wide = F.when(F.col("n_whole") >= min_group, F.concat("of_lang", F.lit(" | +"))).when(F.lit(every >= min_group), F.lit("+"))
    pools = sizes.join(pooled, "of_lang", "left").join(whole, "of_lang").select("own", "of_lang", pool.alias("pool"), wide.alias("wide"))
    pools = stage(pools, "pools")
    left_over = pools.where("pool is null")
    of_table = not left_over.where("wide = '+'").isEmpty()
    of_langs = left_over.where("wide <> '+'").select("of_lang", F.col("wide").alias("asked")).distinct()
    teaches = F.array_compact(F.array("pool", "asked", F.lit("+" if of_table else None)))
    mapped = pools.join(of_langs, "of_lang", "left").select("own", F.coalesce("pool", "wide").alias("cell"), teaches.alias("teaches"))
    return vectors.withColumn("own", own).join(mapped, "own").drop("own")


def judge(docs: DataFrame, support: float = SUPPORT, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """Verdict per document (doc_id, lang, source, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept and distance (null where there is no estimate or the base rules failed already).
    Null and empty texts have zero counts and fail the base rules. A null language or source
    is a group of its own. Repeated rows count as documents each. Other columns are ignored.
    """
    p = len(STATISTICS)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = stage(text_counts(docs).select("*", failed.alias("base_failed")), "text-counts")
    usable = counted.where(~F.col("base_failed")).select("doc_id", "lang", "source", _vector().alias("x"))
    vectors = stage(_cells(usable, min_group).where(F.col("cell").isNotNull()).select(F.explode("teaches").alias("cell"), "x"), "vectors")

    found = stage(_concentrated(vectors, support), "concentrated")
    placed = vectors.join(found, "cell").select("cell", "start", "x", _distance(p).alias("d"))
    near = placed.where(F.col("d") <= chi_square_quantile(0.975, p))
    found = _estimates(near, F.col("x"), _consistency(0.975, p)).select("cell", "mean", "precision")

    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    celled = _cells(counted.where(~F.col("base_failed")).select(*base, "lang", "source", _vector().alias("x")), min_group)
    far = celled.join(found, "cell", "left").select(*base, _distance(p).alias("distance"))
    bad = counted.where("base_failed").select(*base, F.lit(None).cast("double").alias("distance"))
    limit = chi_square_quantile(1 - tail, p)
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= limit))
    return far.unionByName(bad).select(*base, kept.alias("kept"), "distance")
