"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are looked for by windows at every place: of ``WINDOW`` characters (a shorter item is one window), and of
``PASSAGE`` characters, about 13 English words, so that a part of an item is found wherever in the item it starts. A text that
holds a window with at most e edits shares at least n + 1 - q(e + 1) of the window's q-grams with it, all within e
diagonals of each other. So the q-grams of each text are looked up in the benchmark's, hits are counted per item and
overlapping band of diagonals, then for all windows at once in the bands that have enough, and what meets the bound is
verified by an alignment of the window within the band, of edit distance e or less. Case is folded where that keeps a character one
character; e is a tenth of the window's length. Items of under ``SHORT`` characters would occur by chance with edits: they
are looked for whole and unchanged (but for case), with no letter or digit joined to theirs on either side.

The benchmark is dealt by hash to blocks of about ``BLOCK_CHARS`` characters (or one longer item); each is indexed by a task
and its index written to the shared folder. Documents are scanned once; a task gathers about ``HELD`` characters of texts, or with one
block only ``PART``, and holds them against one block after another, so that a block is read once for so much text. Texts
are looked up in parts of about ``PART`` characters (or one longer text) and hits are counted in slices of about
``HITS``, so that repetitive texts and items take time but no more memory. Items longer than ``PIECE`` are indexed in overlapping pieces.

Null, empty or blank texts and items match nothing; null ids are ids of their own; repeated rows count once; an item id that occurs on several rows
stands for all of their texts. Of equally good places of a window in one band the one on the band's commonest diagonal or
else the first counts. An empty table gives an empty result. Other columns of either table, whatever their names, are left alone.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import new_folder, read_file, saved, table, write_file
from callweave.llm.linking import mix64

Q, EDIT_RATE = 8, 0.1
WINDOW, PASSAGE, SHORT = 96, 72, 40
BAND, PIECE = 32, 2048
BLOCK_CHARS = 4_000_000
#: Characters of texts that are looked up at once, and that a task gathers for a reading of several blocks; hits that are counted at once.
PART, HELD, HITS = 1 << 20, 1 << 24, 1 << 20
KEYED = "doc_id long, doc_key long, item_id long, n_windows long, start long, stop long, edits long"


def folded(text: str) -> np.ndarray:
    """Code points, lower case where that is one character for one."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams_of(points: np.ndarray, size: int = Q) -> np.ndarray:
    """Hashes of all runs of ``size`` characters."""
    h = np.zeros(max(0, len(points) - size + 1), np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (points[j : j + len(h)].astype(np.uint64) + np.uint64(1))
    return mix64(h)


def budget(n: int) -> tuple[int, int]:
    """(edits, least shared q-grams) of a window of n characters, n at least SHORT."""
    e = int(EDIT_RATE * n)
    return e, n + 1 - Q * (e + 1)


def window_starts(n: int, size: int = WINDOW) -> list[int]:
    return [*range(max(1, n - size + 1))]


def window_sizes(n: int) -> list[int]:
    """Of the windows of an item of n characters."""
    return [min(n, WINDOW), *([PASSAGE] if n > PASSAGE else [])]


@dataclass
class Index:
    """A block of the benchmark. Items (their rows) of SHORT characters or more are cut into pieces, whose code points lie
    end to end in ``points``; short items lie end to end in ``short``."""

    item: np.ndarray  # id of each row, and whether it is null
    no_id: np.ndarray
    length: np.ndarray  # of each row
    row: np.ndarray  # of each piece
    offset: np.ndarray  # of each piece in its item
    start: np.ndarray  # of each piece in ``points``, and the end
    points: np.ndarray
    gram: np.ndarray  # sorted distinct
    first: np.ndarray  # of each gram in ``place``
    place: np.ndarray  # positions in ``points``
    piece: np.ndarray  # of each of ``place``
    bits: np.ndarray  # which leading 22 bits occur, packed
    short_row: np.ndarray
    short_start: np.ndarray
    short: np.ndarray

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Index:
        with np.load(io.BytesIO(data)) as parts:
            return Index(**{f.name: parts[f.name] for f in fields(Index)})


def index_of(items: list[tuple[int, str]]) -> Index:
    texts = [folded(t) for _, t in items]
    long = [(r, t) for r, t in enumerate(texts) if len(t) >= SHORT]
    short = [(r, t) for r, t in enumerate(texts) if 0 < len(t) < SHORT]
    cut = [(r, at, t[at : at + PIECE]) for r, t in long for at in range(0, max(1, len(t) - WINDOW + 1), PIECE - WINDOW + 1)]
    start = np.cumsum([0, *(len(p) for _, _, p in cut)])
    grams = [grams_of(p) for _, _, p in cut]
    gram = np.concatenate([np.zeros(0, np.uint64), *grams])
    piece = np.repeat(np.arange(len(cut), dtype=np.int32), [len(g) for g in grams])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) + s for g, s in zip(grams, start[:-1], strict=True))]).astype(np.int64)
    order = np.argsort(gram, kind="stable")
    distinct, first = np.unique(gram[order], return_index=True)
    bits = np.zeros(1 << 22, bool)
    bits[(distinct >> np.uint64(42)).astype(np.int64)] = True
    return Index(
        np.array([i or 0 for i, _ in items], np.int64), np.array([i is None for i, _ in items], bool), np.array([len(t) for t in texts], np.int64), np.array([r for r, _, _ in cut], np.int64), np.array([at for _, at, _ in cut], np.int64), start,
        np.concatenate([np.zeros(0, np.uint32), *(p for _, _, p in cut)]), distinct, np.r_[first, len(gram)], place[order], piece[order], np.packbits(bits),
        np.array([r for r, _ in short], np.int64), np.cumsum([0, *(len(t) for _, t in short)]), np.concatenate([np.zeros(0, np.uint32), *(t for _, t in short)]),
    )


def aligned(windows: np.ndarray, at: np.ndarray, text: np.ndarray, diagonals: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, stop) of the best place in ``text`` of each of the windows (rows, all of one length) that begin at
    ``at`` of their item, within ``e`` of the item's diagonals; edits over ``e`` stand for none.

    A place on the commonest diagonal without an edit is taken at once. Else row i of the table holds the costs of the
    windows' first i characters; column k is diagonal low - e + k.
    """
    k, m = windows.shape
    n, low = len(text), int(diagonals.min())
    exact = at + low + int(np.bincount(diagonals - low).argmax())
    edits, start, stop = np.full(k, e + 1), exact.copy(), exact + m
    fits = np.flatnonzero((exact >= 0) & (exact + m <= n))
    same = fits[(text[exact[fits, None] + np.arange(m)] == windows[fits]).all(1)]
    edits[same] = 0
    left = np.flatnonzero(edits > 0)
    if len(left) == 0:
        return edits, start, stop
    lo, width = low - e, int(diagonals.max()) - low + 2 * e + 1
    steps, far = np.arange(width, dtype=np.int32), np.int32(1 << 20)
    # The text along the band, with characters that equal none beyond its ends; what of a row is inside the text.
    place = at[left, None] + lo + np.arange(width + m + 1)
    inside = (place >= 0) & (place < n)
    reach = np.where(inside, text[np.clip(place, 0, n - 1)].astype(np.int64), -1)
    outside = np.where((place >= 0) & (place <= n), 0, far).astype(np.int32)
    own = windows[left].astype(np.int64)
    cost, began = outside[:, :width].copy(), np.broadcast_to(steps, (len(left), width)).copy()
    shifted, from_ = np.full_like(cost, far), np.zeros_like(began)
    for i in range(1, m + 1):
        new = cost + (reach[:, i - 1 : i - 1 + width] != own[:, i - 1 : i])
        shifted[:, :-1] = cost[:, 1:]
        from_[:, :-1] = began[:, 1:]
        better = shifted + 1 < new  # the window's character has none in the text
        new = np.where(better, shifted + 1, new) + outside[:, i : i + width]
        src = np.where(better, from_, began)
        # A text character too many: along the row, from the least of cost minus steps.
        flat = new - steps
        best = np.minimum.accumulate(flat, axis=1)
        cost = best + steps + outside[:, i : i + width]
        began = np.take_along_axis(src, np.maximum.accumulate(np.where(flat == best, steps, 0), axis=1), 1)
        going = cost.min(1) <= e
        if not going.all():
            left, reach, outside, own, cost, began = (x[going] for x in (left, reach, outside, own, cost, began))
            shifted, from_ = shifted[going], from_[going]
            if len(left) == 0:
                return edits, start, stop
    end = cost.argmin(1)
    rows = np.arange(len(left))
    edits[left], start[left], stop[left] = cost[rows, end], at[left] + lo + began[rows, end], at[left] + lo + end + m
    return edits, start, stop


def _bands(diagonal: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Hit number and band of each hit: bands of BAND + overlap diagonals start every BAND."""
    band = diagonal // BAND
    again = np.flatnonzero(diagonal - band * BAND < overlap)
    return np.concatenate([np.arange(len(diagonal)), again]), np.concatenate([band, band[again] - 1])


class Found:
    """Matches of each text and row of items: places of windows, span in the text, least edits."""

    def __init__(self):
        self.rows: dict[tuple[int, int], list] = {}

    def add(self, text: int, row: int, windows: list[tuple[int, int]], start: int, stop: int, edits: int) -> None:
        own = self.rows.setdefault((text, row), [set(), start, stop, edits])
        own[0].update(windows)
        own[1:] = min(own[1], start), max(own[2], stop), min(own[3], edits)


def _word_bounded(text: np.ndarray, at: np.ndarray, n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the places ``at`` .. ``at`` + n have no letter or digit joined to one of their own; ``first`` and ``last``: bounds of the texts."""

    def joined(outer: np.ndarray, inner: np.ndarray, inside: np.ndarray) -> np.ndarray:
        a, b = text[np.where(inside, outer, 0)], text[inner]
        word = {int(c): chr(c).isalnum() for c in np.unique(np.concatenate([a, b]))}
        both = [word[x] and word[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return np.array(both, bool) & inside

    return ~joined(at - 1, at, at > first) & ~joined(at + n, at + n - 1, at + n < last)


def _short(index: Index, text: np.ndarray, start: np.ndarray, sizes: np.ndarray, out: Found) -> None:
    """Short items that occur whole, by the hash of their first characters, Q at most."""
    lengths = np.diff(index.short_start)
    for k in np.unique(np.minimum(lengths, Q)).tolist():
        mine = np.flatnonzero(np.minimum(lengths, Q) == k)
        keys = np.array([grams_of(index.short[index.short_start[i] : index.short_start[i] + k], k)[0] for i in mine], np.uint64)
        grams = grams_of(text, k)
        at = np.flatnonzero(np.isin(grams, keys))
        at = at[np.argsort(grams[at], kind="stable")]
        sorted_grams = grams[at]
        for i, key in zip(mine.tolist(), keys, strict=True):
            lo, hi = np.searchsorted(sorted_grams, key), np.searchsorted(sorted_grams, key, "right")
            points = index.short[index.short_start[i] : index.short_start[i + 1]]
            for here in (at[x : min(hi, x + 65536)] for x in range(int(lo), int(hi), 65536)):
                doc = np.searchsorted(start, here, "right") - 1
                fits = here + len(points) <= start[doc] + sizes[doc]
                here, doc = here[fits], doc[fits]
                same = (text[here[:, None] + np.arange(len(points))] == points).all(1)
                here, doc = here[same], doc[same]
                good = _word_bounded(text, here, len(points), start[doc], start[doc] + sizes[doc])
                for d, p in zip(doc[good].tolist(), (here - start[doc])[good].tolist(), strict=True):
                    out.add(d, int(index.short_row[i]), [(len(points), 0)], p, p + len(points), 0)


def search(index: Index, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
    """(text, row of items, places of windows, start, stop, least edits) for each text and row of the block that match."""
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(sizes) - sizes
    text = np.concatenate([np.zeros(0, np.uint32), *texts])
    out = Found()
    if len(index.short_row):
        _short(index, text, start, sizes, out)
    if len(index.gram):
        grams = grams_of(text)
        bits = np.unpackbits(index.bits).view(bool)
        at = np.flatnonzero(bits[(grams >> np.uint64(42)).astype(np.int64)])
        found = np.minimum(np.searchsorted(index.gram, grams[at]), len(index.gram) - 1)
        same = index.gram[found] == grams[at]
        at, found = at[same], found[same]
        doc = np.searchsorted(start, at, "right") - 1
        ok = at + Q <= start[doc] + sizes[doc]
        _windows(index, texts, start, at[ok], found[ok], doc[ok], out)
    return [(d, r, len(x[0]), *x[1:]) for (d, r), x in out.rows.items()]


def _windows(index: Index, texts: list[np.ndarray], start: np.ndarray, at: np.ndarray, found: np.ndarray, doc: np.ndarray, out: Found) -> None:
    """Windows that match, from the text positions ``at`` (of texts ``doc``) whose q-grams are the index's ``found``.

    Texts are laid out at ``base`` so far apart that no band has hits in two of them. Hits come slice by slice in the order
    of text positions; a band is looked at once no hit can be added, and hits of bands that aren't complete are held.
    """
    n_piece = np.diff(index.start)
    sizes_of = [[(size, *budget(size)) for size in window_sizes(int(n))] for n in index.length[index.row]]
    least = np.array([min(x[2] for x in own) for own in sizes_of], np.int64)
    overlap = max(x[1] for own in sizes_of for x in own)
    gap = int(n_piece.max()) + 2 * (BAND + overlap)
    room = -(-(np.array([len(t) for t in texts], np.int64) + gap) // BAND) * BAND
    base = np.cumsum(room) - room + -(-gap // BAND) * BAND
    where = base[doc] + at - start[doc]
    times = index.first[found + 1] - index.first[found]
    upto = np.cumsum(times)
    place = np.zeros(0, np.int64)
    diagonal, piece, of = place, np.zeros(0, np.int32), np.zeros(0, np.int64)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + HITS, "right")))
        own = times[lo:hi]
        hit = np.repeat(np.arange(lo, hi), own)
        entry = np.repeat(index.first[found[lo:hi]] - np.cumsum(own) + own, own) + np.arange(len(hit))
        new = index.place[entry], index.piece[entry]
        diagonal = np.concatenate([diagonal, where[hit] - (new[0] - index.start[new[1]])])
        place, piece, of = np.concatenate([place, new[0]]), np.concatenate([piece, new[1]]), np.concatenate([of, doc[hit]])
        # No later hit is on a diagonal of the piece that is less than this position less the piece's length.
        done = np.iinfo(np.int64).max if hi == len(at) else int(where[hi - 1])
        which, band = _bands(diagonal, overlap)
        code = band * len(n_piece) + piece[which]
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
        counts = np.diff(np.r_[cuts, len(order)])
        head = which[order[cuts]]
        ready = (counts >= least[piece[head]]) & ((band[order[cuts]] + 1) * BAND + overlap + n_piece[piece[head]] < done)
        for c in np.flatnonzero(ready).tolist():
            rows = which[order[cuts[c] : cuts[c] + counts[c]]]
            k, d = int(piece[rows[0]]), int(of[rows[0]])
            _band(index, k, sizes_of[k], place[rows] - index.start[k], diagonal[rows] - base[d], d, texts[d], out)
        held = diagonal + BAND + overlap + n_piece[piece] >= done
        place, diagonal, piece, of = place[held], diagonal[held], piece[held], of[held]
        lo = hi


def _band(index: Index, k: int, sizes: list[tuple[int, int, int]], within: np.ndarray, diagonal: np.ndarray, doc: int, text: np.ndarray, out: Found) -> None:
    """Windows of piece k that match in a band, of whose hits ``within`` has the places and ``diagonal`` the diagonals."""
    points = index.points[index.start[k] : index.start[k + 1]]
    # How many of the piece's places up to each one have a hit, so that every window is counted at once.
    upto = np.zeros(len(points) + 1, np.int64)
    upto[within + 1] = 1
    upto = np.cumsum(upto)
    for n, e, enough in sizes:
        w = np.arange(len(points) - n + 1)
        w = w[upto[w + n - Q + 1] - upto[w] >= enough]
        # In parts, so that the tables have a bound for long pieces too.
        for own in (w[x : x + 512] for x in range(0, len(w), 512)):
            hits = (within >= own[0]) & (within <= own[-1] + n - Q)
            cost, lo, hi = aligned(points[own[:, None] + np.arange(n)], own, text, diagonal[hits], e)
            good = cost <= e
            if good.any():
                windows = [(n, x) for x in (own[good] + index.offset[k]).tolist()]
                out.add(doc, int(index.row[k]), windows, int(lo[good].min()), int(hi[good].max()), int(cost[good].min()))


@lru_cache(maxsize=1)
def _block(uri: str) -> Index:
    """The last block read stays: the next task of a worker that has no other needs no reading."""
    return Index.from_bytes(read_file(uri))


def written_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[str]:
    """Indexes of the benchmark in the shared folder: their URIs, one per ``block_chars`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("trim(text) <> ''")
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    folder = new_folder(benchmark.sparkSession, "cw-items")

    def work(found: pa.Table) -> pa.Table:
        rows = sorted(zip(found.column("item_id").to_pylist(), found.column("text").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        uri = f"{folder}/{found.column('block')[0].as_py():06d}.npz"
        write_file(uri, index_of(rows).to_bytes())
        return pa.table({"uri": [uri]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-total // block_chars) or 1)))
    return sorted(r.uri for r in dealt.groupBy("block").applyInArrow(work, "uri string").collect())


def look_up(uris: list[str], rows: list[tuple], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Matches of the texts of ``rows`` (doc_id, doc_key), each block read once for all of them and held against one part after another."""
    names = [f.split()[0] for f in KEYED.split(", ")]
    size = np.cumsum([len(t) for t in texts])
    cuts = [0, *(np.flatnonzero(np.diff(size // PART)) + 1).tolist(), len(texts)]
    for uri in uris if rows else []:
        index = _block(uri)
        for lo, hi in zip(cuts, cuts[1:]):
            got = [(*rows[lo + d], None if index.no_id[r] else int(index.item[r]), *rest) for d, r, *rest in search(index, texts[lo:hi])]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*got, strict=True)], names)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, doc_key, item_id, n_windows, start, stop, edits): one row per document and benchmark item with a match;
    doc_key is the hash of the text, n_windows counts the item's windows, of both sizes and at every place, that match,
    start and stop span the matching places in the text, edits is the least of a window."""
    uris = written_blocks(benchmark, block_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for d, k, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "doc_key", "text")), strict=True):
                    rows.append((d, k))
                    texts.append(folded(t or ""))
                    size += len(texts[-1])
                    if size >= (HELD if len(uris) > 1 else PART):
                        yield from look_up(uris, rows, texts)
                        rows, texts, size = [], [], 0
        yield from look_up(uris, rows, texts)

    found = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("doc_key"), "text").mapInArrow(work, KEYED)
    return found.groupBy("doc_id", "doc_key", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("edits").alias("edits")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage."""
    found = saved(contaminated(docs, benchmark).select("doc_key").distinct(), "cw-leaks").select(F.col("doc_key").alias("_cw_key"))
    return docs.join(found, F.xxhash64(docs["text"]) == found["_cw_key"], "left_anti")


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")
