"""Token ids of documents in wavelet-matrix files, one per shard.

Documents are range-partitioned and sorted by id (then by a hash of the text), encoded with a tokenizer, and each
partition writes shard files of about ``SHARD_TOKENS`` ids. A file holds the ids as bit-planes: plane l has bit
(planes - 1 - l) of every id, in an order in which the ids are stably parted by the bits of the planes before; counts of
ones before every 512 bits make rank and select quick. From one file one can read a token, count a token in any range,
find its k-th occurrence, or decode everything. Planes are compressed each by itself.

Writing is a Spark job whose tasks write to the shared folder (any store that pyarrow can open by URI); a task that is run
again writes the same files. What it returns, one row per shard, is kept as a table, and shards get their first id by sums
over partitions and then over shards of a partition. A null text counts as empty and has the end id only. Repeated rows
are encoded each, and equal ids come in order of a hash of their texts. Null ids come first. A very long text is encoded
whole and may make a shard longer. Other columns, whatever their names, aren't looked at. An empty table gives no shards and
an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm.common import new_folder, read_file, saved, table, write_file

END_ID = 2
SHARD_TOKENS = 1 << 22
MAGIC = b"WVMX0001"
BLOCK = 512
#: Chunks of text whose ids a Python worker keeps.
CACHE = 1_200_000
#: White space (any that some tokenizer may take for it) other than a line break, in a set of RE2.
SPACE = r"\t\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: White space that can't be parted by itself: runs of it, but for a line break before a space or two line breaks before a word.
UNSAFE = rf"\A[{SPACE.replace(' ', '')}]| (?:[{SPACE}\n]|\z)|[{SPACE}]\n|\n\n(?:[{SPACE}\n]|\z)"
#: Marks that are a piece of their own behind a letter or digit.
MARKS = '.,;:!?"#$%&()*+-/<=>@[]^_`{|}~'
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
#: Longer words aren't kept.
LONG = 256
#: Bytes of text that are encoded at once.
TEXT_BYTES = 4 << 20


# ---- the matrix ----


def build_planes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit-planes of the ids, as packed bytes, from the highest bit to the lowest."""
    planes = []
    ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    other = np.empty_like(ids)
    for level in range(bits - 1, -1, -1):
        one = (ids & ids.dtype.type(1 << level)) != 0
        planes.append(np.packbits(one, bitorder="little"))
        zeros = len(ids) - int(np.count_nonzero(one))
        np.compress(one, ids, out=other[zeros:])
        np.compress(np.logical_not(one, out=one), ids, out=other[:zeros])
        ids, other = other, ids
    return planes


def decode_planes(planes: list[np.ndarray], n: int) -> np.ndarray:
    """All ids, by undoing the partings from the last plane to the first."""
    ids = np.zeros(n, np.uint16 if len(planes) <= 16 else np.uint32)
    back = np.empty_like(ids)
    for level, plane in enumerate(reversed(planes)):
        one = np.unpackbits(plane, count=n, bitorder="little").view(bool)
        zeros = n - int(np.count_nonzero(one))
        ids[zeros:] |= ids.dtype.type(1 << level)
        back[np.flatnonzero(one)] = ids[zeros:]
        back[np.flatnonzero(np.logical_not(one, out=one))] = ids[:zeros]
        ids, back = back, ids
    return ids


class WaveletMatrix:
    """Access, counts and places of ids, from one file's bytes; planes are unpacked when first asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack("<I", data[8:12])
        self.head = json.loads(data[12 : 12 + size])
        self.n: int = self.head["n"]
        self._data, self._at = data, 12 + size
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._before: dict[tuple[int, int], np.ndarray] = {}

    def _part(self, name: str) -> bytes:
        lo, hi = self.head["parts"][name]
        return zstandard.ZstdDecompressor().decompress(self._data[self._at + lo : self._at + hi])

    def documents(self) -> list[tuple[int | None, int]]:
        """(doc_id, ids of the document with its end) in file order."""
        lengths = np.frombuffer(self._part("lengths"), "<i8")
        ids = np.frombuffer(self._part("doc_ids"), "<i8").astype(object)
        ids[np.frombuffer(self._part("null_ids"), "u1").astype(bool)] = None
        return list(zip(ids.tolist(), lengths.tolist(), strict=True))

    def decode(self) -> np.ndarray:
        return decode_planes([np.frombuffer(self._part(f"plane{k}"), "u1") for k in range(self.head["bits"])], self.n)

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._planes:
            self._planes[k] = np.frombuffer(self._part(f"plane{k}"), "u1"), np.frombuffer(self._part(f"ranks{k}"), "<u4")
        return self._planes[k]

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        plane, ranks = self._plane(k)
        block = i // BLOCK
        rest = plane[block * BLOCK // 8 : -(-i // 8)]
        return int(ranks[block]) + int(np.unpackbits(rest, bitorder="little")[: i - block * BLOCK].sum())

    def _find(self, k: int, bit: int, nth: int) -> int:
        """Position in plane k of the nth bit (from 0) equal to ``bit``."""
        plane, ranks = self._plane(k)
        if (k, bit) not in self._before:
            self._before[k, bit] = ranks.astype(np.int64) if bit else np.arange(len(ranks), dtype=np.int64) * BLOCK - ranks
        upto = self._before[k, bit]
        block = int(np.searchsorted(upto, nth, "right")) - 1
        part = np.unpackbits(plane[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == bit)[nth - int(upto[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for k in range(self.head["bits"]):
            plane, _ = self._plane(k)
            bit = int(plane[i // 8] >> (i % 8) & 1)
            ones = self._ones(k, i)
            i = self.head["zeros"][k] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the positions lo .. hi of ``token`` lie after the last plane."""
        for k in range(self.head["bits"]):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if token >> (self.head["bits"] - 1 - k) & 1:
                lo, hi = self.head["zeros"][k] + a, self.head["zeros"][k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` occurs at positions lo .. hi - 1."""
        if token < 0 or token >> self.head["bits"]:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of ``token``."""
        if not 0 <= nth < self.count(token):
            raise IndexError(f"token {token} has no occurrence {nth}")
        i = self._range(token, 0, self.n)[0] + nth
        for k in range(self.head["bits"] - 1, -1, -1):
            bit = token >> (self.head["bits"] - 1 - k) & 1
            i = self._find(k, bit, i - self.head["zeros"][k] if bit else i)
        return i


def encode_file(ids: np.ndarray, docs: list[tuple[int | None, int]]) -> bytes:
    """The bytes of one shard file: magic, length and JSON of the head, compressed parts."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    planes = build_planes(ids, bits)
    n = len(ids)
    parts: dict[str, bytes] = {}
    zeros = []
    for k, plane in enumerate(planes):
        ones = np.bitwise_count(plane).astype(np.int64)
        padded = np.r_[ones, np.zeros(-len(ones) % (BLOCK // 8), np.int64)].reshape(-1, BLOCK // 8).sum(1)
        parts[f"plane{k}"] = plane.tobytes()
        parts[f"ranks{k}"] = np.r_[0, np.cumsum(padded)].astype("<u4").tobytes()
        zeros.append(n - int(ones.sum()))
    parts["doc_ids"] = np.array([d or 0 for d, _ in docs], "<i8").tobytes()
    parts["null_ids"] = np.array([d is None for d, _ in docs], "u1").tobytes()
    parts["lengths"] = np.array([m for _, m in docs], "<i8").tobytes()
    pressed = zstandard.ZstdCompressor(level=1)
    body, places = [], {}
    at = 0
    for name, raw in parts.items():
        body.append(pressed.compress(raw))
        places[name] = (at, at + len(body[-1]))
        at += len(body[-1])
    head = json.dumps({"n": n, "bits": bits, "zeros": zeros, "parts": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


# ---- encoding ----


class Encoder:
    """Ids of texts by a tokenizer of byte-level pieces, as little-endian bytes of ``dtype``.

    A piece never reaches over a single space that a character other than white space follows, nor into a line break
    behind such a character, so texts are cut into words there: those after a space, and those at the start of a line, which
    keep their line break (a text gets one in front, whose id is dropped). Arrow finds the distinct words of many texts, whose ids
    are looked up or learnt, and each text's ids are gathered by the numbers of its words. A word that isn't known yet is
    parted before marks at its end that follow a letter or digit, where the pattern of the pieces always ends one. The parts
    that aren't known are encoded many at a time: those after a space one after another in a string, as each begins with the
    only id whose piece begins with a space; those at the start of a line with line breaks between. Where a part has letters
    only, it is one piece, and the search for pieces is spared.
    Texts with other runs of white space, or with special tokens, go to the tokenizer whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.of_pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.of_pieces.pre_tokenizer = pre_tokenizers.Split("\u0120", "merged_with_next")
        for t in (self.tokenizer, self.of_pieces):
            if hasattr(t.model, "_resize_cache"):
                t.model._resize_cache(0)  # words are kept here, and hardly any comes twice
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = spec["normalizer"] is None and (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cache = cache
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for piece, i in vocab.items() if piece.startswith("\u0120")]] = True
        self.breaks = np.zeros_like(self.opens)
        self.breaks[vocab.get("\u010a", [])] = True
        self.by_chunk &= bool(self.breaks.any())
        #: The characters that stand for bytes in pieces.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        #: Ids of words (after a space, or with their line break), and of parts that nothing precedes.
        self.chunks: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, known: dict[str, bytes], parts: list[str], mark: str, marks: np.ndarray, plain: bool = False) -> None:
        """Adds the ids of ``parts``, each behind ``mark``, which is in the id that ``marks`` knows: the space in front of a
        part is its own, the line break isn't. Plain parts have letters only."""
        if not parts:
            return
        lead = mark if mark == " " else ""
        strings = [mark + mark.join(parts[at : at + 1000]) for at in range(0, len(parts), 1000)]
        if plain:
            strings = [x.replace(" ", "\u0120") if x.isascii() else x.encode().decode("latin-1").translate(self.byte_chars) for x in strings]
        ids = np.concatenate([np.array(x.ids, self.dtype) for x in (self.of_pieces if plain else self.tokenizer).encode_batch_fast(strings, add_special_tokens=False)])
        at = np.flatnonzero(marks[ids])
        if len(at) == len(parts):
            size, skip = self.dtype.itemsize, 0 if lead else self.dtype.itemsize
            data, cuts = ids.tobytes(), [*(at * size).tolist(), len(ids) * size]
            known.update(zip(parts, (data[lo + skip : hi] for lo, hi in zip(cuts, cuts[1:], strict=False)), strict=True))
        else:
            known.update((c, self._whole(lead + c)) for c in parts)

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of words that aren't known; all but long ones and those with odd white space are kept."""
        column = pa.array(words, pa.large_string())
        base = pc.utf8_rtrim(column, characters=MARKS)
        odd = pc.or_(pc.match_substring_regex(column, f"[{SPACE}]"), pc.greater(pc.utf8_length(column), LONG)).to_numpy(zero_copy_only=False)
        ends = pc.match_substring_regex(base, rf"[{LETTERS}0-9]\z").to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(base, rf"\A[{LETTERS}]+\z").to_numpy(zero_copy_only=False)
        cut = ends & pc.not_equal(base, column).to_numpy(zero_copy_only=False)
        bases = np.where(cut, base.to_numpy(zero_copy_only=False), column.to_numpy(zero_copy_only=False)).tolist()
        line = pc.starts_with(column, "\n").to_numpy(zero_copy_only=False)
        chunks, bare = self.chunks, self.bare
        if "\n" not in bare:
            bare["\n"] = self._whole("\n")
        fresh: tuple[dict[str, None], dict[str, None], dict[str, None]] = {}, {}, {}
        for x, of_plain in zip(bases, np.where(odd | line, 2, plain).tolist(), strict=True):
            if of_plain != 2 and x not in chunks:
                fresh[of_plain][x] = None
        starts = np.flatnonzero(line & ~odd).tolist()
        tails = np.flatnonzero(cut & ~odd).tolist()
        for part in [bases[k][1:] for k in starts] + [words[k][len(bases[k]) :] for k in tails]:
            if part and part not in bare:
                fresh[2][part] = None
        self._learn(bare, list(fresh[2]), "\n", self.breaks)
        self._learn(chunks, list(fresh[0]), " ", self.opens)
        of_letters = list(fresh[1])
        self._learn(chunks, [x for x in of_letters if x.isascii()], " ", self.opens, plain=True)
        self._learn(chunks, [x for x in of_letters if not x.isascii()], " ", self.opens, plain=True)
        for k in starts:
            rest = bases[k][1:]
            chunks[bases[k]] = bare["\n"] + bare[rest] if rest else bare["\n"]
        out = list(map(chunks.get, bases))
        for k in tails:
            chunks[words[k]] = out[k] = out[k] + bare[words[k][len(bases[k]) :]]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._whole(words[k] if line[k] else " " + words[k])
        return out

    def _of_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that can be cut into words."""
        first, glue = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        lists = pc.split_pattern(pc.binary_join_element_wise(first, pc.replace_substring(texts, "\n", " \n"), glue), " ")
        coded = lists.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.chunks.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            for k, ids in zip(missing, self.learn([words[k] for k in missing]), strict=True):
                found[k] = ids
        pool = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        n = sizes[index]
        ends = np.cumsum(n)
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[index] - ends + n, n) + np.arange(ends[-1])]
        data, size = ids.tobytes(), self.dtype.itemsize
        last = ends[np.cumsum(pc.list_value_length(lists).to_numpy()) - 1].tolist()
        return [data[(lo + 1) * size : hi * size] for lo, hi in zip([0, *last], last, strict=False)]  # without the id of the break in front

    def __call__(self, texts: list[str]) -> list[bytes]:
        for name in ("chunks", "bare"):
            if len(known := getattr(self, name)) > self.cache:
                setattr(self, name, dict(islice(known.items(), self.cache // 2)))  # those met first, so the common ones
        column = pa.array(texts, pa.large_string())
        safe = np.full(len(texts), self.by_chunk)
        if self.by_chunk:
            for pattern, find in [(UNSAFE, pc.match_substring_regex), *((x, pc.match_substring) for x in self.special)]:
                safe &= ~find(column, pattern).to_numpy(zero_copy_only=False)
        parted = iter(self._of_words(column.filter(pa.array(safe))) if safe.any() else [])
        return [next(parted) if ok else self._whole(text) for text, ok in zip(texts, safe.tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- jobs ----


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shard files of (doc_id, text) into ``folder``; returns one row per shard in order: part, shard, uri, n_docs, n_tokens, start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or tokenizer_path())
        end = np.array([end_id], encode.dtype).tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        blobs: list[bytes] = []
        docs_: list[tuple[int | None, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, size
            uri = f"{folder}/part-{part:06d}-{shard:06d}.wvm"
            write_file(uri, encode_file(np.frombuffer(b"".join(blobs), encode.dtype), docs_))
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "uri": [uri], "n_docs": [len(docs_)], "n_tokens": [size]})
            blobs.clear()
            docs_.clear()
            shard, size = shard + 1, 0
            return row

        for batch in batches:
            filled = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                rows = batch.slice(at, to - at)
                found = encode([t or "" for t in rows.column("text").to_pylist()])
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), found, strict=True):
                    blobs.append(ids + end)
                    docs_.append((doc_id, len(blobs[-1]) // encode.dtype.itemsize))
                    size += docs_[-1][1]
                    if size >= shard_tokens:
                        yield flush()
        if docs_:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    shards = saved(dealt.mapInArrow(work, "part long, shard long, uri string, n_docs long, n_tokens long"), "cw-shards")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per partition, of which there are as many as shuffle partitions, then the shards within each.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("first"))
    return shards.join(parts, "part").withColumn("start", F.col("first") + before(Window.partitionBy("part").orderBy("shard"))).drop("first")


def read_documents(shards: DataFrame) -> DataFrame:
    """(uri, start) of shards -> doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                matrix = WaveletMatrix(read_file(uri))
                ids = matrix.decode().astype("<u4", copy=False)
                docs = matrix.documents()
                lengths = np.array([m for _, m in docs], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[hi - m : hi].tobytes()) for hi, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in docs], pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("uri", "start").repartition(n, "uri").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = new_folder(docs.sparkSession, "cw-wavelet")
    return read_documents(write_shards(docs, folder, tokenizer))


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "documents"))
