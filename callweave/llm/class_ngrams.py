"""Scoring by a class-based bigram model: exchange clustering, class transitions and word emissions.

Words are the runs of non-white-space of the text with A-Z lowered; each document ends with one end token, which is also
what its first word follows. Counts of all training words are gathered by Spark, and texts are written once as codes: places
in a table of the words with a share of ``TABLE_SHARE`` or more (at most 1 / TABLE_SHARE words, held by each task), and hashes of
all others.

Every training word gets a class. Exchange clustering works on units: each word with a share of ``UNIT_SHARE`` of the tokens
or more is a unit of its own (so there are at most 1 / UNIT_SHARE), and all others are first pooled in ``BUCKETS`` units by a
hash of their last three bytes. In each round a third of the units may go, one after another in each of ``GROUPS`` tasks (few,
as the number of units has a bound), to the class that raises the likelihood of the class bigrams most; rounds end when three
of them raise it by less than ``GAIN`` of it. Then each pooled word gets a class of its own: its neighbours' classes are counted
over the whole corpus (partially per task, then by word), ``PRIOR`` neighbours on either side are added that are spread like its
bucket's, and it joins the class in which these are likeliest. Only words never seen in training keep their bucket's class.
The end token has a class of its own. Class bigrams are then counted again, over the final classes of all training tokens.

score = sum over tokens of log10 p(class | class before) + log10 p(word | class), where transitions are smoothed towards
the class's share with ``SMOOTH`` pseudo-counts and p(word | class) = (c + 1) / (N_class + V_class + 1), so a word never
seen has the one place left in its class. perplexity = 10 ** (-score / n_tokens).

A null or empty text has the end token only. Rows with a null id count as training rows. Repeated rows count each. Texts of
any length are scored whole. Of classes that are equally good for a unit or word the first counts, or the one that it has.
Other columns, whatever their names, aren't looked at. With no training rows all counts are 0 and N is 0. An empty table
gives an empty result. Words carry 64-bit hashes; among a billion words the chance that any two share one is about 0.03.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import saved, table

UNIT_SHARE, TABLE_SHARE, BUCKETS = 1e-4, 1e-6, 512
CLASSES, GROUPS, SMOOTH, PRIOR = 64, 4, 64.0, 4.0
ROUNDS, GAIN = 36, 2e-4
#: Different words that a task holds counts of, and pooled tokens of a task whose neighbours are counted together.
HELD_WORDS, FLUSH = 400_000, 2_000_000
END = b" "  # no word holds a space
NAME = "cw-lm"
#: Stands for the class of a token that is looked up later; classes are less, and slots of neighbours fit a byte.
OTHER = 255
CODED = "row long, doc_id long, held boolean, codes binary, rare array<long>"
STARTED = "row long, doc_id long, held boolean, n_known long, logs double, seq binary, others binary, n_rare int"
LINED = "doc_id long, held boolean, n_tokens long, n_known long, logs double, seq binary"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the training rows, the end token among them. Tasks count their words before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            words, times = list(seen), list(seen.values())
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), pa.array(times[at : at + 50_000], pa.int64())], ["word", "c"])
            seen.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(0).slice(at, 512).to_pylist()
                for text in texts:
                    seen.update(words_of(text))
                seen[END] += len(texts)
                if len(seen) > HELD_WORDS:
                    yield from counted()
        yield from counted()

    words = docs.filter(~held_out(F.col("doc_id"))).select("text").mapInArrow(work, "word binary, c long")
    return words.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c"))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordIndex(dict):
    """word -> its place in the table of common words; any other word -> the table's size plus its bucket."""

    def __init__(self, common: list[bytes]):
        super().__init__(zip(common, range(len(common)), strict=True))
        self.size = len(common)

    def __missing__(self, word: bytes) -> int:
        return self.size + zlib.crc32(word[-3:]) % BUCKETS

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_hash(words: list[bytes]) -> np.ndarray:
    """The hash that Spark's ``xxhash64`` gives each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in words), np.uint64, len(words)).view(np.int64)


def coded(docs: DataFrame, common) -> DataFrame:
    """Every row as codes of its words and end token: a place in the table, or -1 - (number * BUCKETS + bucket), where number
    tells which of the hashes ``rare`` of the row's other words it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WordIndex(common.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, rare = [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    words.append(END)
                    i = index.of(words)
                    names: dict[bytes, int] = {}
                    others = np.flatnonzero(i >= index.size)
                    number = np.array([names.setdefault(words[x], len(names)) for x in others.tolist()], np.int64)
                    i[others] = -1 - (number * BUCKETS + i[others] - index.size)
                    codes.append(i.astype("<i4").tobytes())
                    rare.append(word_hash(list(names)))
                rows = [part.column("row"), part.column("doc_id"), part.column("held"), pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, ["row", "doc_id", "held", "codes", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return rows.mapInArrow(work, CODED)


def _joined(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of bytes, end to end, and how many each value has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype), np.array([len(v) for v in values], np.int64) // np.dtype(dtype).itemsize


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _units(codes: np.ndarray, unit: np.ndarray, n_own: int) -> np.ndarray:
    return np.where(codes >= 0, unit[np.maximum(codes, 0)], n_own + (-1 - codes) % BUCKETS)


def unit_bigrams(rows: DataFrame, tables, n_own: int) -> DataFrame:
    """(a, b, n): how often unit b follows unit a in training rows."""
    n_units = n_own + BUCKETS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                codes, _ = _joined(batch.column(0).slice(at, 512), "<i4")
                u = np.r_[0, _units(codes, tables.value["unit"], n_own)]
                parts.append(np.unique(u[:-1] * n_units + u[1:], return_counts=True))
                held += len(parts[-1][0])
                if held > 4_000_000:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
        if parts:
            code, n = _merged(parts)
            for at in range(0, len(code), 100_000):
                c = code[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c // n_units), pa.array(c % n_units), pa.array(n[at : at + 100_000])], ["a", "b", "n"])

    pairs = rows.filter("not held").select("codes").mapInArrow(work, "a long, b long, n long")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(own: int, matrix: np.ndarray, after: np.ndarray, before: np.ndarray, twice: float) -> int:
    """The class in which a unit of class ``own`` makes the bigrams likeliest. ``after`` and ``before``: how often a unit of
    each class follows and precedes it, itself included (``twice``). Class 0 is the end token's."""
    m, after, before = matrix.copy(), after.copy(), before.copy()
    m[own, :] -= after
    m[:, own] -= before
    m[own, own] += twice
    after[own] -= twice
    before[own] -= twice
    left, right = m.sum(1) + before, m.sum(0) + after  # what the totals are with the unit in another class
    rows, cols, diag = _f(m + after[None, :]) - _f(m), _f(m + before[:, None]) - _f(m), np.diagonal(m)
    gain = rows.sum(1) - np.diagonal(rows) + cols.sum(0) - np.diagonal(cols) + _f(diag + after + before + twice) - _f(diag)
    out, into = after.sum() + twice, before.sum() + twice
    gain -= _f(left + out) - _f(left) + _f(right + into) - _f(right)
    gain[0] = -np.inf
    best = int(gain.argmax())
    return own if gain[best] <= gain[own] + 1e-9 else best


def class_of(classes: np.ndarray, unit: str) -> Column:
    """The class of the unit in a column, from a constant array (there are at most 1 / UNIT_SHARE + BUCKETS units)."""
    return F.get(F.split(F.lit(",".join(map(str, classes.tolist()))), ",").cast("array<int>"), F.col(unit).cast("int"))


def class_matrix(bigrams: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Class bigrams: at most n_classes squared rows reach the driver."""
    out = np.zeros((n_classes, n_classes))
    for r in bigrams.groupBy(class_of(classes, "a").alias("ka"), class_of(classes, "b").alias("kb")).agg(F.sum("n").alias("n")).collect():
        out[r.ka, r.kb] = r.n
    return out


def moved(bigrams: DataFrame, classes: np.ndarray, matrix: np.ndarray, part: int) -> np.ndarray:
    """The classes after one round in which the units u with (u mod 3) = ``part`` may move (0, the end token, never).

    They are dealt to ``GROUPS`` tasks, each of which moves its units one after another and keeps its own class bigrams up
    to date; without that, units that belong together would change places for ever.
    """
    c = len(matrix)
    own = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    sides = bigrams.select(F.col("a").alias("u"), F.col("b").alias("other"), F.lit(0).alias("side"), "n", own.alias("own"))
    sides = sides.union(bigrams.select(F.col("b").alias("u"), F.col("a").alias("other"), F.lit(1).alias("side"), "n", F.lit(0).alias("own")))
    sides = sides.filter((F.col("u") % 3 == part) & (F.col("u") > 0))
    vectors = sides.groupBy("u", "side", class_of(classes, "other").alias("k")).agg(F.sum("n").alias("n"), F.sum("own").alias("own"))

    def work(t: pa.Table) -> pa.Table:
        u, side, k, n, own = (t.column(x).to_numpy() for x in ("u", "side", "k", "n", "own"))
        units, at = np.unique(u, return_inverse=True)
        both = np.zeros((2, len(units), c))
        np.add.at(both, (side, at, k), n)
        twice = np.bincount(at, own, len(units))
        m, to = matrix.copy(), classes[units].astype(np.int32)
        for i, x in enumerate(units):
            k = best_class(own_k := int(classes[x]), m, both[0, i], both[1, i], twice[i])
            if k != own_k:
                after, before = both[0, i].copy(), both[1, i].copy()
                m[own_k, :] -= after
                m[:, own_k] -= before
                m[own_k, own_k] += twice[i]
                after[own_k] -= twice[i]
                before[own_k] -= twice[i]
                m[k, :] += after
                m[:, k] += before
                m[k, k] += twice[i]
                to[i] = k
        return pa.table({"u": units, "k": to})

    grouped = vectors.withColumn("g", F.floor(F.col("u") / 3) % GROUPS).groupBy("g")
    out = classes.copy()
    for r in grouped.applyInArrow(work, "u long, k int").collect():
        out[r.u] = r.k
    return out


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what doesn't depend on the classes."""
    return float(_f(matrix).sum() - _f(matrix.sum(0)).sum() - _f(matrix.sum(1)).sum())


def exchange(bigrams: DataFrame, n_units: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units, and the class bigrams. Unit 0 is the end token; the rest start dealt round by number."""
    classes = np.r_[0, 1 + np.arange(n_units - 1) % (n_classes - 1)]
    matrix = class_matrix(bigrams, classes, n_classes)
    before = likelihood(matrix)
    for k in range(rounds):
        classes = moved(bigrams, classes, matrix, k % 3)
        matrix = class_matrix(bigrams, classes, n_classes)
        if k % 3 == 2:
            if (now := likelihood(matrix)) - before <= GAIN * abs(before):
                break
            before = now
    return classes, matrix


def transitions(matrix: np.ndarray) -> np.ndarray:
    """p(class | class before), smoothed."""
    in_class = matrix.sum(0)
    share = (in_class + 1) / (in_class.sum() + len(matrix))
    return (matrix + SMOOTH * share[None, :]) / (matrix.sum(1)[:, None] + SMOOTH)


def bucket_vectors(bigrams: DataFrame, classes: np.ndarray, n_own: int, n_classes: int) -> np.ndarray:
    """Shares of the classes that follow and that precede each bucket's words: at most BUCKETS x 2 n_classes rows reach the driver."""
    sides = bigrams.select(F.col("a").alias("u"), F.col("b").alias("o"), F.lit(0).alias("side"), "n")
    sides = sides.union(bigrams.select(F.col("b").alias("u"), F.col("a").alias("o"), F.lit(1).alias("side"), "n")).filter(F.col("u") >= n_own)
    out = np.zeros((BUCKETS, 2, n_classes))
    for r in sides.groupBy("u", "side", class_of(classes, "o").alias("k")).agg(F.sum("n").alias("n")).collect():
        out[r.u - n_own, r.side, r.k] = r.n
    return (out / np.maximum(out.sum(2, keepdims=True), 1)).reshape(BUCKETS, -1)


def neighbours(rows: DataFrame, tables, classes: np.ndarray, n_own: int, n_classes: int) -> DataFrame:
    """(h, met): which classes follow (slot k) and precede (slot n_classes + k) pooled training words, by hash of the word. A word
    has a row for every ``FLUSH`` pooled tokens of a task that hold it; ``met`` has its bucket in two bytes, then slots and
    their times in one byte each (a slot comes again where 255 isn't enough)."""
    wide = 2 * n_classes

    def counted(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, bucket, after, before = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        names, first, at = np.unique(h, return_index=True, return_inverse=True)
        at = at.astype(np.int32)
        code = np.concatenate([at * wide + after, at * wide + n_classes + before])
        code.sort()
        cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n, code = np.diff(np.r_[cuts, len(code)]), code[cuts]
        again = -(-n // 255)
        last = np.cumsum(again) - 1
        code = np.repeat(code, again)
        times = np.full(len(code), 255, np.uint8)
        times[last] = n - 255 * (again - 1)
        ends = np.searchsorted(code, np.arange(len(names) + 1) * wide)
        # Each row: two bytes of the bucket, then pairs.
        place = 2 * ends + 2 * np.arange(len(names) + 1)
        data = np.empty(int(place[-1]), np.uint8)
        mine = bucket[first]
        data[place[:-1]], data[place[:-1] + 1] = mine & 255, mine >> 8
        pair = 2 * np.arange(len(code)) + 2 * (np.repeat(np.arange(len(names)), np.diff(ends)) + 1)
        data[pair], data[pair + 1] = code % wide, times
        for lo in range(0, len(names), 20_000):
            cut = place[lo : lo + 20_001]
            met = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut - cut[0]).astype(np.int32)), pa.py_buffer(data[cut[0] : cut[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 20_000]), met], ["h", "met"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, sizes = _joined(part.column("codes"), "<i4")
                rare = part.column("rare").to_pylist()
                of = np.cumsum([0, *map(len, rare)])[:-1]
                every = np.array([h for own in rare for h in own], np.int64)
                u = _units(codes, t["unit"], n_own)
                k = classes[u]
                pooled = np.flatnonzero(u >= n_own)
                c = codes[pooled]
                place = np.repeat(of, sizes)[pooled] + (-1 - c) // BUCKETS
                h = t["hash"][np.maximum(c, 0)]
                h[c < 0] = every[place[c < 0]]
                # The end token follows every document's words, so the next token is one of the same document.
                parts.append((h, (u[pooled] - n_own).astype(np.int16), k[pooled + 1].astype(np.uint8), np.r_[0, k][pooled].astype(np.uint8)))
                held += len(h)
                if held >= FLUSH:
                    yield from counted(parts)
                    parts, held = [], 0
        if parts:
            yield from counted(parts)

    return rows.filter("not held").select("codes", "rare").mapInArrow(work, "h long, met binary")


def likeliest(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class in which words with these neighbours (classes that follow, then classes that precede) are likeliest."""
    step = np.log(transitions(matrix))
    n = len(matrix)
    after, before = vectors[:, :n], vectors[:, n:]
    gain = after @ step.T + before @ step - before.sum(1)[:, None] * np.log(matrix.sum(0) + 1)[None, :]
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def assigned(found: DataFrame, matrix: np.ndarray, prior: np.ndarray) -> DataFrame:
    """Rows of ``neighbours`` -> (h, k): the class of each word. Words are brought together by a shuffle and a sort, and taken
    one batch at a time."""
    wide = 2 * len(matrix)

    def chosen(h: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
        k = likeliest(dense + PRIOR * prior[bucket], matrix)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(k.astype(np.int32))], ["h", "k"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                h = part.column("h").to_numpy()
                data, sizes = _joined(part.column("met"), "u1")
                at_ = np.cumsum(sizes) - sizes
                row = np.repeat(np.arange(len(h)), sizes // 2)
                pairs = data.reshape(-1, 2)
                is_pair = np.ones(len(pairs), bool)
                is_pair[at_ // 2] = False
                new = np.r_[True, h[1:] != h[:-1]]
                word = np.cumsum(new) - 1
                dense = np.bincount(word[row[is_pair]] * wide + pairs[is_pair, 0], pairs[is_pair, 1], (word[-1] + 1) * wide).reshape(-1, wide)
                own = pairs[at_ // 2].astype(np.int64)
                names, bucket = h[new], (own[:, 0] + 256 * own[:, 1])[new]
                if held is not None:
                    if held[0][0] == names[0]:
                        dense[0] += held[2][0]
                    else:
                        yield chosen(*held)
                yield chosen(names[:-1], bucket[:-1], dense[:-1])
                held = names[-1:], bucket[-1:], dense[-1:]
        if held is not None:
            yield chosen(*held)

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(work, "h long, k int")


def started(rows: DataFrame, tables) -> DataFrame:
    """Rows of ``STARTED``: the classes of the tokens that are in the table as bytes (``OTHER`` for all others), what these tokens add to the scores, and
    the codes of the others, -1 - code each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        logs = np.log10(t["c"] + 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, sizes = _joined(part.column("codes"), "<i4")
                starts, place, rare = np.cumsum(sizes) - sizes, np.maximum(codes, 0), codes < 0
                seq, data = np.where(rare, OTHER, t["k"][place]).astype(np.uint8).tobytes(), (-1 - codes[rare]).astype("<i4").tobytes()
                known = np.add.reduceat((t["c"][place] > 0) & ~rare, starts, dtype=np.int64)
                sums = np.add.reduceat(np.where(rare, 0.0, logs[place]), starts)
                n = np.add.reduceat(rare, starts, dtype=np.int64)
                ends = np.cumsum(n) * 4
                others = [data[hi - 4 * m : hi] for hi, m in zip(ends.tolist(), n.tolist(), strict=True)]
                lines = [seq[lo : lo + m] for lo, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(known), pa.array(sums), pa.array(lines, pa.binary()), pa.array(others, pa.binary()), part.column("n_rare")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "held")), *columns], ["row", "doc_id", "held", "n_known", "logs", "seq", "others", "n_rare"])

    return rows.select("row", "doc_id", "held", "codes", F.size("rare").alias("n_rare")).mapInArrow(work, STARTED)


def lined(rows: DataFrame, known: DataFrame, tables) -> DataFrame:
    """Rows of ``LINED``: the classes of each row's tokens as bytes, and what of the scores depends on counts alone.
    ``known`` has (h, c, k) of the training words that aren't in the table."""
    words = rows.select("row", F.posexplode("rare").alias("j", "h")).join(known, "h")
    found = words.groupBy("row").agg(F.collect_list(F.struct("j", "k", "c")).alias("found"))
    whole = started(rows, tables).join(found, "row", "left")
    whole = whole.select("doc_id", "held", "n_known", "logs", "seq", "others", "n_rare", *[F.col(f"found.{x}").alias(x) for x in "jkc"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k_bucket = tables.value["k_bucket"]
        names = ("n_known", "logs", "seq", "others", "n_rare", "j", "k", "c")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for n_known, logs, line, others, n, j, k, c in zip(*(part.column(x).to_pylist() for x in names), strict=True):
                    if n:
                        k_of, c_of = np.full(n, -1, np.int64), np.zeros(n, np.int64)
                        if j:
                            k_of[j], c_of[j] = k, c
                        number, bucket = np.divmod(np.frombuffer(others, "<i4"), BUCKETS)
                        own, times = k_of[number], c_of[number]
                        seq = np.frombuffer(line, np.uint8).copy()
                        seq[seq == OTHER] = np.where(own >= 0, own, k_bucket[bucket])
                        line, n_known, logs = seq.tobytes(), n_known + int((times > 0).sum()), logs + float(np.log10(times + 1.0).sum())
                    out.append((len(line), n_known, logs, line))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.binary()]
                arrays = [pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held"), *arrays], ["doc_id", "held", "n_tokens", "n_known", "logs", "seq"])

    return whole.mapInArrow(work, LINED)


def final_matrix(lines: DataFrame, n_classes: int) -> np.ndarray:
    """Class bigrams of the training rows: at most n_classes squared rows reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                seq = np.r_[0, _joined(batch.column(0).slice(at, 512), "u1")[0].astype(np.int64)]
                n += np.bincount(seq[:-1] * n_classes + seq[1:], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["code", "n"])

    out = np.zeros(n_classes * n_classes)
    for r in lines.filter("not held").select("seq").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(n_classes, n_classes)


def scores(docs: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS, unit_share: float = UNIT_SHARE, table_share: float = TABLE_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. There can be 128 classes."""
    sc = docs.sparkSession.sparkContext
    counts = saved(word_counts(docs), NAME)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # At most 1 / table_share words can have that share.
    often = counts.filter((F.col("c") >= table_share * n) & (F.col("word") != END.decode())).orderBy(F.desc("c"), "word").toArrow()
    ends = counts.filter(F.col("word") == END.decode()).first()
    c = np.r_[ends.c if ends else 0, often.column("c").to_numpy()].astype(np.int64)
    words = [END, *(w.encode("utf-8", "surrogatepass") for w in often.column("word").to_pylist())]
    n_own = 1 + int((c[1:] >= unit_share * n).sum())
    bucket = np.fromiter((zlib.crc32(w[-3:]) % BUCKETS for w in words), np.int64, len(words))
    hashes = word_hash(words)
    tables = sc.broadcast({"unit": np.where(np.arange(len(c)) < n_own, np.arange(len(c)), n_own + bucket), "hash": hashes})
    rows = saved(coded(docs, sc.broadcast(words)), NAME, "zstd")
    bigrams = saved(unit_bigrams(rows, tables, n_own), NAME)
    classes, matrix = exchange(bigrams, n_own + BUCKETS, n_classes, rounds)
    own = saved(assigned(neighbours(rows, tables, classes, n_own, n_classes), matrix, bucket_vectors(bigrams, classes, n_own, n_classes)), NAME)

    known = counts.select(F.xxhash64("word").alias("h"), "c").join(own, "h")
    in_table = known.filter(F.col("c") >= table_share * n).select("h", "k").toArrow()
    k_of = np.r_[classes[:n_own], np.zeros(len(words) - n_own, np.int64)]
    place = np.argsort(hashes, kind="stable")
    k_of[place[np.searchsorted(hashes[place], in_table.column("h").to_numpy())]] = in_table.column("k").to_numpy()
    types = np.bincount(classes[:n_own][c[:n_own] > 0], minlength=n_classes).astype(float)
    for r in own.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():
        types[r.k] += r.n
    final = sc.broadcast({"k": k_of, "c": c, "k_bucket": classes[n_own:]})
    lines = saved(lined(rows, known.filter(F.col("c") < table_share * n), final), NAME)
    matrix = final_matrix(lines, n_classes)
    step = np.log10(transitions(matrix)) - np.log10(matrix.sum(0) + types + 1)[None, :]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seq, sizes = _joined(part.column("seq"), "u1")
                seq = np.r_[0, seq]  # each row ends with the end token, which the next one's first word follows
                steps = np.add.reduceat(step[seq[:-1], seq[1:]], np.cumsum(sizes) - sizes)
                columns = [part.column(x) for x in ("doc_id", "held", "n_tokens", "n_known", "logs")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(steps)], ["doc_id", "held", "n_tokens", "n_known", "logs", "steps"])

    out = lines.mapInArrow(work, "doc_id long, held boolean, n_tokens long, n_known long, logs double, steps double")
    score = F.col("logs") + F.col("steps")
    return out.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op3_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
