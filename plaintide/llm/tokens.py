"""Token ids on disk: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

A shard file holds the documents of one doc_id range. Its layout, little-endian:

    magic "PTID", version u32, header length u64
    header: n_docs u64, n_ids u64, n_ranks u32, 0 u32; the ids by falling frequency (ties: smaller first) u32 each;
            per document doc_id i64 and number of ids u64; a byte per document, 1 if its doc_id is null
    control bytes: two bits an id, four ids a byte, low bits first: bytes of its rank less 1
    data bytes: the ranks, each in 1 to 4 bytes

Every shard has its own rank table, so that a shard lost with its executor is encoded again alone.
A file is written under a temporary name and renamed, so readers never see part of one.

Null texts count as empty and give one end id. Rows with equal doc_id keep the order of a hash of their text; a null
doc_id comes first. An empty table gives no shard and no row.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.llm.work import cut, new_path, shuffle_partitions

MAGIC = b"PTID"
END_ID = 0
#: Entries of a worker's cache, half of them at most from before its last turn; ids of one shard file.
CACHE, SHARD_IDS = 1 << 20, 1 << 22
#: Characters of the texts whose words are looked up together.
SLICE_CHARS = 1 << 23
_SPLIT, _SPACES = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")
#: How a byte-level tokenizer parts a text.
_PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts of ASCII, line ends and the letters from U+00C0 to U+024F alone.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_COMMON = re.compile(rf"[\n -~{_LETTERS}]*").fullmatch
_MARKS = frozenset(".,;:!?\n")
_COMMON_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+").findall

#: For a control byte: where each of its four ranks begins in their bytes, their lengths, and the sum.
_LENGTH = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_TOTAL = _LENGTH.sum(1)
_BEGIN = np.cumsum(_LENGTH, 1) - _LENGTH
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


class Encoder:
    """The tokenizers library behind a bounded cache of space-led words.

    A byte-level tokenizer never joins a single space that leads a non-space character to what stands before it, so
    a text's ids are those of its words in turn. New words of common scripts go straight to the library's
    model, others to its whole pipeline, and texts with a special token, or for other kinds of tokenizer, go to
    the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        before = told.get("pre_tokenizer") or {}
        self.by_piece = told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.words, self.parts = _Pieces(self._word), _Pieces(self._part)
        self.model = self.library.model.tokenize
        split = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        byte_char = {b: split(chr(b))[0][0] for b in range(128)}  # how the library writes each byte
        two = [split(chr(c))[0][0] for c in range(128, 0x800)]
        byte_char |= {b: x[k] for c, x in zip(range(128, 0x800), two, strict=True) for k, b in enumerate(chr(c).encode())}
        self.bytes_as_chars = byte_char
        self.space = byte_char[32]

    def _ids(self, written: str) -> bytes:
        return array("I", [x.id for x in self.model(written)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        return self._ids(part.encode().decode("latin-1").translate(self.bytes_as_chars))

    def _parted(self, text: str) -> bytes:
        if _COMMON(text):
            first, *rest = _COMMON_PART(text) or ("",)
            # a space-led word is the entry it has when it stands alone
            led = self.words[first[1:]] if first[:1] == " " and first[1:].isalpha() else self.parts[first] if first else b""
            return led + b"".join(map(self.parts.__getitem__, rest)) if rest else led
        if max(text) < "\u0530" and text.replace("\n", "").isprintable():
            return b"".join(map(self.parts.__getitem__, _PART.findall(text)))
        return self._whole(text)

    def _word(self, word: str) -> bytes:
        """Ids of a piece and the space that led it."""
        if word.isalpha():
            if word.isascii():
                return array("I", [x.id for x in self.model(self.space + word)]).tobytes()
            if _COMMON(word):
                return self._part(" " + word)
        elif (plain := word[:-1]).isalpha() and word[-1] in _MARKS and _COMMON(plain):
            return self.words[plain] + self.parts[word[-1]]
        return self._parted(" " + word)

    def _simple(self, text: str) -> bool:
        """Every space of the text leads a word."""
        return self.by_piece and not _SPACES.search(text) and not any(x in text for x in self.special)

    def encode(self, text: str) -> bytes:
        """Ids as native unsigned 32-bit integers."""
        if not self.by_piece or any(x in text for x in self.special):
            return self._whole(text)
        first, *pieces = _SPLIT.split(text)
        return self._parted(first) + b"".join(map(self.words.__getitem__, pieces))

    def encode_all(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in turn, ``end`` behind each, and how many each has.

        Words are looked up once for all of them, and their ids laid out by position; callers give texts of bounded size together.
        """
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        simple = [self._simple(x) for x in texts]
        # what is not simple is one word of its own
        known: dict[str, int] = {}
        parted = pc.split_pattern(pa.array([x if ok else "" for x, ok in zip(texts, simple, strict=True)], pa.large_string()), " ")
        offset = parted.offsets.to_numpy().astype(np.int64)
        coded = parted.flatten().dictionary_encode()
        made = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        at = coded.indices.to_numpy().astype(np.int64)
        firsts = np.empty(len(texts), np.int64)
        for i, (text, ok) in enumerate(zip(texts, simple, strict=True)):
            head = text.partition(" ")[0] if ok else text
            place = known.get(head) if ok else None
            if place is None:
                place = len(made)
                made.append(self._parted(head) if ok else self.encode(text))
                if ok:
                    known[head] = place
            firsts[i] = place
        at[offset[:-1]] = firsts
        at = np.insert(at, offset[1:], len(made))
        made.append(array("I", [end]).tobytes())
        self.words.turn()
        self.parts.turn()
        length = np.fromiter(map(len, made), np.int64, len(made)) // 4
        pool = np.frombuffer(b"".join(made), np.uint32)
        n = length[at]
        through = np.cumsum(n)
        shift = (np.cumsum(length) - length)[at] - (through - n)
        last = offset[1:] + np.arange(len(texts))
        return pool[np.repeat(shift, n) + np.arange(through[-1])], np.diff(through[last], prepend=0)


class _Pieces(dict):
    """Ids by piece, made when first asked for. At half its size the entries become the older ones, which are asked before a new
    one is made; so what is common stays."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = self.make(piece)
        self[piece] = got
        return got

    def turn(self) -> None:
        if len(self) > CACHE // 2:
            self.older = dict(self)
            self.clear()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process: its file is read once and its caches last."""
    return Encoder(path)


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """Ids by falling frequency, control bytes, data bytes."""
    if not len(ids):
        return np.zeros(0, "<u4"), b"", b""
    if ids.max() < 1 << 22:
        times = np.bincount(ids)
        known = np.flatnonzero(times)
        times = times[known]
    else:
        known, times = np.unique(ids, return_counts=True)
    order = np.lexsort((known, -times))
    if known[-1] < 1 << 22:
        rank_of = np.zeros(known[-1] + 1, np.uint32)
        rank_of[known[order]] = np.arange(len(known))
        rank = rank_of[ids]
    else:
        rank_of = np.empty(len(known), np.uint32)
        rank_of[order] = np.arange(len(known))
        rank = rank_of[np.searchsorted(known, ids)]
    size = 1 + (rank > 0xFF).astype(np.int64) + (rank > 0xFFFF) + (rank > 0xFFFFFF)
    padded = np.zeros(-(-len(rank) // 4) * 4, np.uint8)
    padded[: len(rank)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = rank.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    return known[order].astype("<u4"), control.tobytes(), data.tobytes()


def unpack(known: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Ids again: lengths and offsets come from tables by control byte."""
    if not n:
        return np.zeros(0, np.uint32)
    # the last control byte may stand for fewer than four; the rest of its entries read the padding
    group = np.concatenate(([0], np.cumsum(_TOTAL[control])))[:-1]
    at = (group[:, None] + _BEGIN[control]).reshape(-1)[:n]
    size = _LENGTH[control].reshape(-1)[:n]
    wide = np.concatenate((data, np.zeros(4, np.uint8)))
    word = wide[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        word[more] |= wide[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return known[word]


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    known, control, data = pack(ids)
    header = struct.pack("<QQII", len(doc_ids), len(ids), len(known), 0) + known.tobytes()
    header += np.array([x or 0 for x in doc_ids], "<i8").tobytes() + counts.astype("<u8").tobytes() + bytes(x is None for x in doc_ids)
    return MAGIC + struct.pack("<IQ", 1, len(header)) + header + control + data


def read_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, all ids."""
    if blob[:4] != MAGIC or struct.unpack_from("<I", blob, 4)[0] != 1:
        raise ValueError("not a token shard of version 1")
    n_docs, n_ids, n_known, _ = struct.unpack_from("<QQII", blob, 16)
    at = 40
    known = np.frombuffer(blob, "<u4", n_known, at)
    at += 4 * n_known
    doc_ids = np.frombuffer(blob, "<i8", n_docs, at)
    counts = np.frombuffer(blob, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    none = np.frombuffer(blob, np.uint8, n_docs, at + 16 * n_docs)
    at += 17 * n_docs
    n_control = -(-n_ids // 4)
    control = np.frombuffer(blob, np.uint8, n_control, at)
    data = np.frombuffer(blob, np.uint8, -1, at + n_control)
    return [None if z else int(x) for x, z in zip(doc_ids, none, strict=True)], counts, unpack(known, control, data, n_ids)


def write(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write shards of ``docs`` in ascending doc_id order to ``folder``; returns shard, path, n_docs, n_tokens.

    Shard names sort in doc_id order. One shuffle, of the texts, sorts them by range.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    placed = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        codes = encoder(tokenizer)
        held_ids: list[int | None] = []
        held: list[np.ndarray] = []
        held_counts: list[np.ndarray] = []
        state = {"n": 0, "size": 0}

        def flush(number: int) -> pa.RecordBatch:
            ids, counts = np.concatenate(held), np.concatenate(held_counts)
            name = f"{number:06d}-{state['n']:06d}"
            path = f"{base}/{name}.ptid"
            temporary = f"{path}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(shard_bytes(held_ids, counts, ids))
            store.move(temporary, path)
            row = pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "shard": [name], "path": [path], "n_docs": [len(held_ids)], "n_tokens": [len(ids)]})
            for x in (held_ids, held, held_counts):
                x.clear()
            state.update(n=state["n"] + 1, size=0)
            return row

        number = 0
        for part in parts:
            if part.num_rows:
                number = part.column(0)[0].as_py()
            texts = [x or "" for x in part.column(2).to_pylist()]
            for at, some in _slices(texts):
                ids, counts = codes.encode_all(some, END_ID)
                held.append(ids)
                held_counts.append(counts)
                held_ids += part.column(1).slice(at, len(some)).to_pylist()
                state["size"] += len(ids)
                if state["size"] >= SHARD_IDS:
                    yield flush(number)
        if held:
            yield flush(number)

    return cut(placed.mapInArrow(run, "part int, shard string, path string, n_docs long, n_tokens long"), "shards")


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Texts of bounded size together, a longer one alone, with the index of the first."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > SLICE_CHARS:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(text)
    if texts:
        yield at, texts[at:]


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids_crc32, one row per document.

    The ids before a shard are those of the parts before its own, one row a part, and a running sum inside its part.
    """
    spark = manifest.sparkSession
    sizes = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select(F.col("part").alias("of"), (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = manifest.withColumn("inside", inside).join(before, F.col("part") == F.col("of")).select("path", (F.col("before") + F.col("inside")).alias("base"))
    listed = placed.repartition(max(1, min(manifest.count(), 4 * shuffle_partitions(spark))))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for part in parts:
            for path, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                with store.open_input_stream(path) as file:
                    doc_ids, counts, ids = read_shard(file.read())
                stop = np.cumsum(counts)
                ids = np.ascontiguousarray(ids, "<u4")
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(stop, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base + stop - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return listed.mapInArrow(run, READ)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a new folder below the shared one and read it back."""
    folder = new_path(docs.sparkSession, "token-shards")
    return read(write(docs, tokenizer, folder), folder)
