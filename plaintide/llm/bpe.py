"""BPE as a bounded-lookahead streaming transducer, and incremental decoding.

A text is read in blocks of bounded size. Normaliser, word splitter and merges keep their state from block to block: characters that
may still compose wait for what follows, the word that a block ends in stays open, and within a word a token is emitted once as many
symbols follow it as the merge list can look ahead. The ids of a block go to their readers (digests, the decoder) before the next
block is read, so neither a long text nor a word without end needs more memory than a block and a window. A bounded cache holds what
the transducer made of short words.

How far a merge can look: whether the pair ``u v`` merges depends on what stands right of it only if a right
end of ``v`` (``v`` itself, or a last part of it that was still apart) joins its right neighbour in an earlier merge. Such
a merge has a smaller rank, so chains end; the longest chain, in symbols, is the sufficient lookahead. It is found
by one pass over the merges in rank order.

Null texts count as empty: no ids, empty decoded text. Repeated rows give equal rows.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an input block; entries of a worker's cache, half of them at most from before its last turn; characters of the longest.
BLOCK, CACHE, LONGEST = 1 << 16, 1 << 18, 64
_SPACE = re.compile(r"[ \n]")
#: Word parts, as the tokenizer's file states them.
SUPPORTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it shows, else one from U+0100 on."""
    shows = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shows)]
    return [chr(b) if b in set(shows) else chr(256 + hidden.index(b)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols right of a token that can still change it, at most.

    ``reach[r]`` bounds what merge r can depend on right of its pair. For every right end s of v, the merges
    ``s w`` that come before s is used up count with the symbols of w and their own reach.
    """
    parts: dict[str, tuple[str, str, int]] = {}
    by_left: dict[str, tuple[list[int], list[int]]] = {}  # ranks of merges with that left part, best reach up to each
    longest = 0
    for rank, (u, v) in enumerate(merges):
        reach, part, used = 0, v, rank
        while True:
            ranks, best = by_left.get(part, ((), ()))
            before = bisect_left(ranks, used)
            if before:
                reach = max(reach, best[before - 1])
            made = parts.get(part)
            if made is None:
                break
            part, used = made[1], made[2]
        ranks, best = by_left.setdefault(u, ([], []))
        ranks.append(rank)
        best.append(max(best[-1] if best else 0, len(v) + reach))
        parts.setdefault(u + v, (u, v, rank))
        longest = max(longest, reach, len(v) + reach)
    return longest


class Transducer:
    """A merge list with its lookahead: symbols in, tokens out as soon as they are stable."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        #: Symbols held before stable tokens are given up: the lookahead, and enough beyond it to make that worth while.
        longest = max((len(u) + len(v) for u, v in merges), default=1)
        self.window = self.lookahead + max(self.lookahead, longest) + 64

    def merged(self, symbols: list[str]) -> list[str]:
        """Tokens of a bounded list of symbols: the merge of least rank first, leftmost among equals."""
        rank, never = self.rank.get, len(self.rank)
        ranks = [rank(two, never) for two in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), never)
        return symbols

    def open(self) -> Word:
        return Word(self)

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word whose symbols come one by one; the last carries the word-end suffix already."""
        word = self.open()
        for x in symbols:
            yield from word.push([x])
        yield from word.end()


class Word:
    """A word on its way through the transducer: symbols are pushed, tokens come back once they are stable."""

    def __init__(self, bpe: Transducer) -> None:
        self.bpe, self.held = bpe, []
        self.most = 0  # symbols held at once, so far

    def push(self, symbols: list[str]) -> list[str]:
        """Take symbols of one character each, or a last one with the word-end suffix."""
        room = self.bpe.window - len(self.held)
        if len(symbols) <= room:
            self.held += symbols
            return []
        out: list[str] = []
        at = 0
        while at < len(symbols):
            if len(self.held) >= self.bpe.window:
                out += self._settle()
            room = max(1, self.bpe.window - len(self.held))  # a token longer than the window's margin needs one more
            self.held += symbols[at : at + room]
            at += room
            self.most = max(self.most, len(self.held))
        return out

    def _settle(self) -> list[str]:
        """Give up the tokens that no later symbol can change. None of the held symbols is the word's last."""
        out, at = [], 0
        for t in self.bpe.merged(self.held[:]):
            if at + len(t) + self.bpe.lookahead > len(self.held):
                break
            out.append(t)
            at += len(t)
        self.held = self.held[at:]
        return out

    def end(self) -> list[str]:
        self.most = max(self.most, len(self.held))
        out, self.held = self.bpe.merged(self.held), []
        return out


class Codec:
    """Encode and decode as the tokenizer of a file does, without special tokens added."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        steps = told["pre_tokenizer"]["pretokenizers"]
        norms = [x["type"] for x in told["normalizer"]["normalizers"]]
        if steps[0]["pattern"]["Regex"] != SUPPORTED or norms != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only lower-casing word BPE files are supported")
        merges = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.bpe = Transducer(self.vocab, merges, self.suffix)
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.piece = {i: x for x, i in [*self.vocab.items(), *self.special.items()]}
        self.decoder = told.get("decoder")
        self.chars = byte_chars()
        self.part = regex.compile(SUPPORTED)
        self.runs = {"l": regex.compile(r"[\p{L}]+"), "o": regex.compile(r"[^\s\p{L}\p{N}]+")}
        self.words: dict[str, tuple[int, ...]] = _Made(self._word)
        self.chunks: dict[str, tuple[int, ...]] = _Made(self._chunk)

    def _known(self, tokens: Iterable[str]) -> list[int]:
        return [self.vocab[t] for t in tokens if t in self.vocab]

    def _word(self, word: str) -> tuple[int, ...]:
        """A whole word through the transducer."""
        if word.isascii() and word.isprintable():
            symbols = [*word[:-1], word[-1] + self.suffix]
        else:
            symbols = [self.chars[b] for b in word.encode("utf-8")]
            symbols[-1] += self.suffix
        state = self.bpe.open()
        return tuple(self._known([*state.push(symbols), *state.end()]))

    def _lowered(self, chunk: str) -> str:
        if not chunk.isascii():
            # one character at a time: a final capital sigma is lowered like any other
            chunk = unicodedata.normalize("NFC", chunk).replace("\u03a3", "\u03c3")
        return chunk.lower()

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a bounded run without space or newline."""
        if not chunk:
            return ()
        chunk = self._lowered(chunk)
        if chunk.isascii() and chunk.isalpha():
            return self._word(chunk)
        out: list[int] = []
        for part in self.part.findall(chunk):
            out += self.words[part]
        return tuple(out)

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, block by block."""
        at = 0
        for found in self.split_special.finditer(text) if self.split_special else ():
            yield from self._piece(text, at, found.start())
            yield [self.special[found.group()]]
            at = found.end()
        yield from self._piece(text, at, len(text))

    def _piece(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """Blocks end at a space or newline; a run of more than ``BLOCK`` characters without any goes through :meth:`_run`."""
        while at < end:
            stop = min(end, at + BLOCK)
            if stop < end:
                gap = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                if gap < 0:
                    found = _SPACE.search(text, stop, end)
                    stop = found.start() if found else end
                    yield from self._run(text, at, stop)
                    at = stop
                    continue
                stop = gap + 1
            self.words.turn()
            self.chunks.turn()
            out: list[int] = []
            for ids in map(self.chunks.__getitem__, _SPACE.split(text[at:stop])):
                out += ids
            yield out
            at = stop

    def _run(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """A run without space or newline, segment by segment, with the splitter's and the transducer's state between them."""
        open_: Word | None = None  # the word that goes on, of which kind, and its last symbol, which may yet be its end
        kind = last = carry = ""
        for segment, final in segments(text, at, end):
            part = carry + self._lowered(segment)
            out: list[int] = []
            i = 0
            while i < len(part):
                if open_ is None:
                    if part[i] == "'" and len(part) - i < 3 and not final:
                        break  # a contraction, perhaps
                    found = self.part.match(part, i)
                    if not found:
                        i += 1  # white space of another kind
                        continue
                    i = found.end()
                    kind = next((k for k, r in self.runs.items() if r.fullmatch(found.group())), "")
                    if i < len(part) or final or not kind or found.group() in CONTRACTIONS:
                        out += self.words[found.group()] if len(found.group()) <= self.bpe.window else self._word(found.group())
                        continue
                    open_, more = self.bpe.open(), found.group()
                else:
                    found = self.runs[kind].match(part, i)
                    more = found.group() if found else ""
                    i += len(more)
                symbols = [*([last] if last else []), *(self.chars[b] for b in more.encode("utf-8"))]
                last = symbols.pop()
                out += self._known(open_.push(symbols))
                self.most = max(self.most, open_.most)
                if i < len(part) or final:
                    out += self._known([*open_.push([last + self.suffix]), *open_.end()])
                    open_, last = None, ""
            carry = part[i:]
            yield out
        if open_ is not None:
            yield self._known([*open_.push([last + self.suffix]), *open_.end()])

    #: Symbols that any open word held at once, so far.
    most = 0

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        state = self.decoder_state()
        return state.feed(ids) + state.end()

    def decoder_state(self) -> Decoder:
        return Decoder(self)


#: What is one part although letters or marks may follow.
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


class Decoder:
    """Ids to text, as they come. Without a decoder in the file, tokens are written as they are, one space between; else
    bytes of a character that is not whole yet wait for the next token."""

    def __init__(self, codec: Codec) -> None:
        self.piece, self.gap = codec.piece, None if codec.decoder is not None else ""
        self.bytes = ByteText(codec.chars)

    def feed(self, ids: Iterable[int]) -> str:
        try:
            known = list(map(self.piece.__getitem__, ids := list(ids)))
        except KeyError:
            known = [self.piece[i] for i in ids if i in self.piece]
        if self.gap is None:
            return "".join(map(self.bytes.feed, known))
        if not known:
            return ""
        gap, self.gap = self.gap, " "
        return gap + " ".join(known)

    def end(self) -> str:
        return self.bytes.end() if self.gap is None else ""


class ByteText:
    """Byte-level pieces to text."""

    def __init__(self, chars: list[str]) -> None:
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, piece: str) -> str:
        try:
            raw = bytes([self.byte_of[c] for c in piece])
        except KeyError:  # a special token: written as it is
            raw = piece.encode("utf-8")
        return self.state.decode(raw)

    def end(self) -> str:
        return self.state.decode(b"", final=True)


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that may compose with one before them, or trade places with it."""
    second = {x[1] for c in map(chr, range(0x110000)) if len(x := _canonical(c)) == 2}
    jamo = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(second | jamo)


def _canonical(c: str) -> str:
    told = unicodedata.decomposition(c)
    return "" if not told or told[0] == "<" else "".join(chr(int(x, 16)) for x in told.split())


def segments(text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
    """Bounded segments of ``text[at:end]`` that normalise each for itself, and whether it is the last. A cut stands before a
    character that composes with nothing before it; only a run of combining characters is longer than a block."""
    while at < end:
        stop = min(end, at + BLOCK)
        while stop < end and not text[stop].isascii() and (unicodedata.combining(text[stop]) or text[stop] in _joining() or unicodedata.combining(unicodedata.normalize("NFD", text[stop])[0])):
            stop += 1
        yield text[at:stop], stop == end
        at = stop


class _Made(dict):
    """Ids by word, made when first asked for. At half its size the entries become the older ones, which are asked before a new
    one is made; so what is common stays."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]) -> None:
        self.make = make
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST:
            self[key] = got
        return got

    def turn(self) -> None:
        if len(self) > CACHE // 2:
            self.older = dict(self)
            self.clear()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for all tasks of a worker process: its file is read once and its caches last."""
    return Codec(path)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every text: number of ids, and digests of the ids and of the decoded text, fed block by block."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        decimal = {i: str(i) for i in coder.piece}
        for part in parts:
            counts, ids_digest, text_digest = [], [], []
            for text in part.column(1).to_pylist():
                of_ids, of_text, decoder, n = hashlib.sha256(), hashlib.sha256(), coder.decoder_state(), 0
                for ids in coder.stream(text or ""):
                    if ids:
                        of_ids.update((" " * (n > 0) + " ".join(map(decimal.__getitem__, ids))).encode())
                        of_text.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
                        n += len(ids)
                of_text.update(decoder.end().encode())
                counts.append(n)
                ids_digest.append(of_ids.hexdigest())
                text_digest.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encode_documents(docs: DataFrame, tokenizer: str, rows: int = 500, most: int = 1 << 22) -> DataFrame:
    """doc_id, source, n_tokens, the ids and a digest of what they decode to, in Arrow batches of up to ``rows`` rows or ``most`` ids.

    Null texts give no ids. ``source`` is null where ``docs`` has none.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)

        def batch(part: pa.RecordBatch, a: int, held: list[np.ndarray], digests: list[str]) -> pa.RecordBatch:
            counts = np.fromiter(map(len, held), np.int64, len(held))
            flat = pa.array(np.concatenate(held), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), flat)
            return pa.RecordBatch.from_arrays([part.column(0).slice(a, len(held)), part.column(2).slice(a, len(held)), pa.array(counts), ids, pa.array(digests, pa.string())], ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"])

        for part in parts:
            a, held, digests, size = 0, [], [], 0
            for i, text in enumerate(part.column(1).to_pylist()):
                got, of_text, decoder = [np.zeros(0, np.int32)], hashlib.sha256(), coder.decoder_state()
                for ids in coder.stream(text or ""):
                    got.append(np.array(ids, np.int32))
                    of_text.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
                of_text.update(decoder.end().encode())
                held.append(np.concatenate(got))
                digests.append(of_text.hexdigest())
                size += len(held[-1])
                if len(held) >= rows or size >= most:
                    yield batch(part, a, held, digests)
                    a, held, digests, size = i + 1, [], [], 0
            if held:
                yield batch(part, a, held, digests)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    return slim.mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, decoded_sha256 string")
