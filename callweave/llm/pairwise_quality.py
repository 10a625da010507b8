"""Quality scores by Bradley-Terry pairwise ranking.

Texts become vectors of shares and lengths (symbols, digits, capitals, marks, repeated words, lines and 3-word windows,
word and line lengths). Labelled training documents of both qualities form preference pairs, every good one before every bad
one; the weights minimise the mean logistic loss on the differences of their vectors. The threshold is the quantile of the
labelled scores above which as many lie as are labelled good; scores are mapped to 0 .. 1 by the logistic function so that the
threshold comes to ``CUT``.

All labelled training documents and all their pairs count, by passes over the saved vectors of the labelled: means and
deviations, then two passes for each step of Newton's method, then the scores, whose quantile is found exactly by counts
of leading bits. Sums over pairs depend on a document's partners by smooth functions of its score only, so they come from sums
at grid points of the score, ``STEP`` apart: a value between them is interpolated from the ``NODES`` next ones, to about
1e-11. To the driver go one row for each grid point that is in use, and counts. Texts are passed once. Labels are
taken from rows whose crc32 of the id, modulo 4, isn't 2; several labels of an id, and several rows of it, count each. A null text counts as empty; rows with a null id are scored and not learnt from. Repeated
rows are scored each. Without labels of both qualities all scores are 0.5. Texts of any
length are measured whole. Equal vectors have equal scores, and a score at the threshold is predicted good. Other columns,
whatever their names, aren't looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import saved, table

RIDGE, CUT = 1.0, 0.7
#: Grid of scores for sums over pairs: distance of its points, and how many of them give a value between.
STEP, NODES = 0.125, 10
NAMES = (
    "words word_length chars_line symbols digits capitals marks commas calls other_bytes caps_words bare_words short_words long_words "
    "same_words same_next same_lines same_windows longest_word one_line bars blanks"
).split()
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".;:", b",", b"!?", bytes(range(128, 256)), b"|", b" \t\n\x0b\x0c\r"), 1):
    _KIND[list(_chars)] = _k


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=10) / size
    if n == 0:
        return np.zeros(len(NAMES), np.float32)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for line in data.split(b"\n") if (x := line.strip())]
    distinct = set(words)
    follow = sum(a == b for a, b in zip(words, words[1:], strict=False))
    windows = max(1, n - 2)
    values = {
        "words": np.log1p(n), "word_length": np.log(lengths.mean()), "chars_line": np.log1p(size / len(lines)),
        "symbols": np.sqrt(kinds[1] + kinds[8]), "digits": np.sqrt(kinds[2]), "capitals": np.sqrt(kinds[3]), "marks": np.sqrt(kinds[4]), "commas": np.sqrt(kinds[5]),
        "calls": np.sqrt(kinds[6]), "other_bytes": np.sqrt(kinds[7]), "bars": np.sqrt(kinds[8]), "blanks": kinds[9],
        "caps_words": sum(map(bytes.isupper, words)) / n, "bare_words": 1 - sum(map(bytes.isalpha, words)) / n,
        "short_words": (lengths <= 3).mean(), "long_words": (lengths >= 13).mean(),
        "same_words": 1 - len(distinct) / n, "same_next": np.sqrt(follow / n), "same_lines": np.sqrt(1 - len(set(lines)) / len(lines)),
        "same_windows": np.sqrt(max(0, 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / windows)) if n > 2 else 0.0,
        "longest_word": words.count(max(distinct, key=lambda w: (len(w), w))) / n, "one_line": float(len(lines) == 1),
    }
    return np.array([values[k] for k in NAMES], np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.stack([features(t) for t in part.column("text").to_pylist()])
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, x array<float>")


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised values, kept within 6, and their sizes beyond the mean."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, np.abs(z)], 1)


def newton(width: int, ridge: float, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], steps: int = 25) -> np.ndarray:
    """Weights at which a loss with a ridge is least; ``sums`` gives the loss's slope and curvature at weights."""
    w = np.zeros(width)
    for _ in range(steps):
        slope, curve = sums(w)
        move = np.linalg.solve(curve + ridge * np.eye(width), slope + ridge * w)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit_pairs(good: np.ndarray, bad: np.ndarray, partners: int | None = None, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-w (good - bad))) over all pairs, with a ridge: for vectors at hand.
    With ``partners``, over that many drawn partners of each vector."""
    if partners is None:
        i, j = np.repeat(np.arange(len(good)), len(bad)), np.tile(np.arange(len(bad)), len(good))
    else:
        rng = np.random.default_rng(20240)
        i = np.concatenate([np.repeat(np.arange(len(good)), partners), rng.integers(0, len(good), len(bad) * partners)])
        j = np.concatenate([rng.integers(0, len(bad), len(good) * partners), np.repeat(np.arange(len(bad)), partners)])
    d = good[i] - bad[j]
    share = (len(good) + len(bad)) / len(d)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        return -share * (d.T @ p), share * ((d * (p * (1 - p))[:, None]).T @ d)

    return newton(d.shape[1], ridge, sums, steps)


def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)).astype(float)


def rank_scores(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z w, row by row: the same for a vector in whatever batch it comes."""
    return np.einsum("ij,j->i", z, w)


def interpolation(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of ``NODES`` grid points round each score, and their weights in a smooth function's value there."""
    at = np.floor(s / STEP)
    u = s / STEP - at
    offsets = np.arange(NODES) - (NODES // 2 - 1)
    weights = np.ones((len(s), NODES))
    for k, own in enumerate(offsets):
        for other in offsets[offsets != own]:
            weights[:, k] *= (u - other) / (own - other)
    return at.astype(np.int64) + offsets[0], weights


def sums_of(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and, in a row each, the sums of the vectors that ``work`` gives for them in each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = work(batches)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["key", "sums"])

    def add(part: pa.Table) -> pa.Table:
        keys, place = np.unique(part.column("key").to_numpy(), return_inverse=True)
        values = part.column("sums").combine_chunks().flatten().to_numpy().reshape(len(place), -1)
        total = np.zeros((len(keys), values.shape[1]))
        np.add.at(total, place, values)
        return pa.table({"key": pa.array(keys), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    schema = "key long, sums array<double>"
    found = sorted(rows.mapInArrow(task, schema).groupBy(F.floor(F.col("key") / 32)).applyInArrow(add, schema).collect())
    return np.array([r.key for r in found], np.int64), np.array([r.sums for r in found], float)


def weighted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors and their numbers of good and bad labels."""
    return vectors_of(batch), batch.column("good").to_numpy().astype(float), batch.column("bad").to_numpy().astype(float)


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """Means and deviations of the labelled vectors, numbers of good and of bad labels; None without both."""

    def first(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros(2 + len(NAMES))
        for batch in batches:
            x, good, bad = weighted(batch)
            total += np.r_[good.sum(), bad.sum(), (good + bad) @ x]
        return {0: total}

    _, sums = sums_of(rows, first)
    total = sums.sum(0) if len(sums) else np.zeros(2)
    n_good, n_bad = int(total[0]), int(total[1])
    if not n_good or not n_bad:
        return None
    mean = np.round(total[2:] / (n_good + n_bad), 12)  # sums in another order end in the same digits

    def second(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros(len(NAMES))
        for batch in batches:
            x, good, bad = weighted(batch)
            total += (good + bad) @ (x - mean) ** 2
        return {0: total}

    _, (total,) = sums_of(rows, second)
    return mean, np.maximum(np.round(np.sqrt(total / (n_good + n_bad)), 12), 1e-3), n_good, n_bad


def pair_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, share: float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature at w of the loss over all pairs of ``rows``, times ``share``."""
    width = len(w)

    def at_points(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        cells: dict[int, np.ndarray] = {}
        for batch in batches:
            x, good, bad = weighted(batch)
            z = expanded(x, mean, scale)
            first, weights = interpolation(rank_scores(z, w))
            values = np.concatenate([good[:, None], bad[:, None], z * good[:, None], z * bad[:, None]], 1)
            order = np.argsort(first, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(first[order])) + 1) if len(order) else []:
                cell = cells.setdefault(int(first[part[0]]), np.zeros((NODES, values.shape[1])))
                cell += weights[part].T @ values[part]
        points: dict[int, np.ndarray] = {}
        for at, cell in cells.items():
            for k, value in enumerate(cell):
                points[at + k] = points[at + k] + value if at + k in points else value
        return points

    keys, sums = sums_of(rows, at_points)
    n_good, n_bad, z_good, z_bad = sums[:, 0], sums[:, 1], sums[:, 2 : 2 + width], sums[:, 2 + width :]
    slope, mixed = np.zeros(width), np.zeros((width, width))
    # By grid point: the curvature of all partners of a good and of a bad document there.
    lowest = int(keys[0])
    of_good, of_bad = np.zeros((2, int(keys[-1]) - lowest + 1))
    for at in range(0, len(keys), 256):
        here = slice(at, at + 256)
        p = 1 / (1 + np.exp(np.clip((keys[here, None] - keys[None]) * STEP, -60, 60)))
        q = p * (1 - p)
        slope += z_bad.T @ (n_good[here] @ p) - z_good[here].T @ (p @ n_bad)
        mixed += z_good[here].T @ (q @ z_bad)
        of_good[keys[here] - lowest] = q @ n_bad
        of_bad[keys - lowest] += n_good[here] @ q

    def own(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros((width, width))
        for batch in batches:
            x, good, bad = weighted(batch)
            z = expanded(x, mean, scale)
            first, weights = interpolation(rank_scores(z, w))
            places = first[:, None] - lowest + np.arange(NODES)
            total += z.T @ (z * (good * (weights * of_good[places]).sum(1) + bad * (weights * of_bad[places]).sum(1))[:, None])
        return dict(enumerate(total))

    _, curve = sums_of(rows, own)
    return share * slope, share * (curve - mixed - mixed.T)


def ordered_bits(s: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; the same again leads back."""
    bits = s.view(np.int64) if s.dtype == np.float64 else s
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def exact_quantile(keys: DataFrame, share: float, total: int) -> float:
    """The quantile of the numbers with bits ``key``, each ``n`` times, ``total`` in all, by counts of 16 bits more in each pass."""
    place = share * (total - 1)
    low = int(np.floor(place))
    found: list[tuple[int | None, int]] = [(None, low), (None, min(low + 1, total - 1))]
    for shift in (48, 32, 16, 0):
        rows = keys if shift == 48 else keys.filter(F.shiftright("key", shift + 16).isin([p for p, _ in found]))
        counts = sorted(rows.groupBy(F.shiftright("key", shift).alias("p")).agg(F.sum("n").alias("n")).collect())
        for k, (prefix, rest) in enumerate(found):
            for p, n in counts:
                if prefix is None or p >> 16 == prefix:
                    if rest < n:
                        found[k] = p, rest
                        break
                    rest -= n
    a, b = ordered_bits(np.array([p for p, _ in found], np.int64)).view(np.float64).tolist()
    return a + (b - a) * (place - low)


def fit(vectors: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(mean, scale, weights, threshold) from all labelled training rows; None without both qualities."""
    own = labels.filter("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    own = own.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    rows = saved(vectors.join(own, "doc_id").select("x", "good", "bad"), "cw-labelled")
    found = moments(rows)
    if found is None:
        return None
    mean, scale, n_good, n_bad = found
    share = (n_good + n_bad) / n_good / n_bad
    w = np.round(newton(2 * len(mean), RIDGE, lambda w: pair_sums(rows, mean, scale, share, w)), 9)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good, bad = weighted(batch)
            s = rank_scores(expanded(x, mean, scale), w) + 0.0  # no -0.0
            yield pa.RecordBatch.from_arrays([pa.array(ordered_bits(s)), pa.array((good + bad).astype(np.int64))], ["key", "n"])

    keys = saved(rows.mapInArrow(work, "key long, n long"), "cw-scores")
    return mean, scale, w, exact_quantile(keys, 1 - n_good / (n_good + n_bad), n_good + n_bad)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    vectors = saved(featured(docs), "cw-features")
    model = fit(vectors, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch)
            score = np.full(len(x), 0.5)
            if model is not None:
                mean, scale, w, cut = model
                score = 1 / (1 + np.exp(np.clip(-(rank_scores(expanded(x, mean, scale), w) - cut + np.log(CUT / (1 - CUT))), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = vectors.mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
