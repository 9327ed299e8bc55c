"""BPE encoding and decoding by a bounded-lookahead transducer.

A merge list decides a token boundary from a bounded number of bytes to its right.  ``MergeTable.lookahead`` computes
a sufficient bound from the list itself: merge r = (u, v) can only be prevented or made possible by what happens to the
bytes of v, that is by an earlier merge s whose left part u_s stands at v's left edge (u_s is v or one of the tokens on
v's left spine).  So with need(r) the bytes right of the u|v seam that can matter,

    need(r) = max(len(v), max over such s of len(u_s) + need(s)),

a recursion over ranks that one pass in rank order solves.  ``StreamEncoder`` keeps a window of bytes, merges it, and
emits each token that ends at least that bound (and one byte, since the last byte of a word has its own symbol) before
the window's end; what stays is bounded, whatever the word's length.  A suffix of a tokenization is the tokenization of
its bytes, so the window may restart at any emitted boundary.

``Transducer`` takes a text in blocks of ``BLOCK`` characters: it holds back what the next block may still change (a
white-space-free run of up to ``RUN`` characters, or the end of a longer one), splits runs into words, and emits ids as
soon as they are stable; words longer than the lookahead pass through the window.  ``StreamDecoder`` turns ids back into
bytes by a table and bytes into text by a state machine that holds at most three bytes of an unfinished character.  Ids
and decoded bytes go into their digests block by block, so that beside the text itself a task holds a bounded number of
bytes.  Runs of up to ``RUN`` characters that were seen before come from a memo of bounded size.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelwright.llm.common import give_back, string_rows, text_pieces

_NONE = 1 << 60
_SHIFT = 20
_LOW = (1 << _SHIFT) - 1
_SPREAD, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: White space of the vocabulary file's text rules, which is not quite Python's.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Conjoining vowels and finals, which compose with what stands before them without being marks.
JOINING = "\u1160-\u11ff\ud7b0-\ud7ff"
BLANKS = regex.compile("[" + WHITE + "]+")
ODD_BLANKS = regex.compile(r"[\x1c-\x1f]")
#: Entries of a memo before it is emptied, characters of a block, and those of the longest run that is kept in the memo.
MEMO, BLOCK, RUN = 150_000, 1 << 16, 1024
#: Where a run may be cut before it is normalised: before what neither composes with nor is reordered among what stands before it.
_SAFE = regex.compile(r"[^\p{M}" + JOINING + "]")


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


def _word_pattern(spec: dict) -> regex.Pattern:
    """The file's word pattern, with its white space; ValueError for text rules other than those that this module follows."""
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if steps != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or [r["type"] for r in rest] != ["ByteLevel"]:
        raise ValueError("a vocabulary file with other text rules")
    return regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))


class MergeTable:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = _word_pattern(spec)
        self.piece = {i: s for s, i in (*vocab.items(), *self.special.items())}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        self.length = {i: len(s.removesuffix(self.end)) or 1 for s, i in vocab.items()}
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.merges: dict[int, int] = {}
        ordered = []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x << _SHIFT | y) not in self.merges:
                self.merges[x << _SHIFT | y] = rank << _SHIFT | z
                ordered.append((x, y, z))
        self.lookahead = self._lookahead(ordered)
        self._open = None
        self._decoding: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def decoding(self, pieces: bool) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids one after another, where each begins): a space and the vocabulary string, or the word's bytes and a space at its end."""
        if pieces not in self._decoding:
            out = []
            for i in range(max(self.piece) + 1):
                piece = self.piece.get(i, "")
                if pieces or piece in self.special:
                    out.append((" " * pieces + piece).encode())
                else:
                    ends = bool(self.end) and piece.endswith(self.end)
                    out.append(bytes(self.byte_of[c] for c in piece.removesuffix(self.end)) + b" " * ends)
            self._decoding[pieces] = np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])
        return self._decoding[pieces]

    def _lookahead(self, ordered: list[tuple[int, int, int]]) -> int:
        parts = {}
        for x, y, z in ordered:
            parts.setdefault(z, (x, y))
        reach: dict[int, int] = {}  # by token u: most of len(u) + need over merges so far with left part u
        most = 1
        for x, y, _ in ordered:
            need, t = self.length[y], y
            while True:
                need = max(need, reach.get(t, 0))
                if t not in parts:
                    break
                t = parts[t][0]
            reach[x] = max(reach.get(x, 0), self.length[x] + need)
            most = max(most, need)
        return most + 1

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols merged by rank, leftmost first among equals."""
        get = self.merges.get
        ranks = [get(a << _SHIFT | b, _NONE) for a, b in zip(ids, ids[1:])]
        if len(ids) > 64:
            return self._merge_long(ids, ranks)
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            new = best & _LOW
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _SHIFT | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << _SHIFT | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int], ranks: list[int]) -> list[int]:
        """``merge`` with a heap of pairs; one that changed meanwhile is passed over."""
        get, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i, r in enumerate(ranks) if r != _NONE]
        heapify(heap)
        while heap:
            best, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << _SHIFT | ids[j], _NONE) != best:
                continue
            ids[i], ids[j], k = best & _LOW, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] << _SHIFT | ids[k], _NONE)) != _NONE:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << _SHIFT | ids[i], _NONE)) != _NONE:
                heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def _pair_arrays(self) -> tuple[np.ndarray, np.ndarray, int]:
        """An open table over the merges: slot of a pair's key, then its rank and id; at most ``probes`` slots away."""
        if self._open is None:
            size, probes = 1 << 19, 1
            keys, values = np.full(size + 64, -1, np.int64), np.full(size + 64, _NONE, np.int64)
            for k, v in self.merges.items():
                at = (k * _SPREAD & _WORD) >> 45
                n = 1
                while keys[at] >= 0:
                    at, n = at + 1, n + 1
                keys[at], values[at], probes = k, v, max(probes, n)
            self._open = keys, values, probes
        return self._open

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, values, probes = self._pair_arrays()
        k = a << _SHIFT | b
        at = ((k.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(45)).astype(np.int64)
        out = np.where(keys[at] == k, values[at], _NONE)
        left = np.flatnonzero((keys[at] >= 0) & (out == _NONE))
        for p in range(1, probes):
            if not len(left):
                break
            slot = at[left] + p
            hit = keys[slot] == k[left]
            out[left[hit]] = values[slot[hit]]
            left = left[~hit & (keys[slot] >= 0)]
        return out

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many non-empty words, one after another, and each word's bounds in them; one merge a word and round."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = np.array(self.inner, np.int64)[flat]
        sym[ends - 1] = np.array(self.last, np.int64)[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), _NONE, np.int64)
        rank[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            runs = np.diff(np.concatenate([first, [len(sym)]]))
            over = best == _NONE
            if over.any():
                gone = np.repeat(over, runs)
                done.append((word[gone], sym[gone]))
                stay = ~gone
                sym, word, rank, best, runs = sym[stay], word[stay], rank[stay], best[~over], runs[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, runs))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            sym[at] = best & _LOW
            rank[at] = rank[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            again = at - np.arange(len(at))
            sym, word, rank = sym[stay], word[stay], rank[stay]
            more = again[again + 1 < len(sym)]
            more = more[word[more] == word[more + 1]]
            rank[more] = self._ranks(sym[more], sym[more + 1])
            ended = np.setdiff1d(again, more, assume_unique=True)
            rank[ended] = _NONE
            less = again[again > 0] - 1
            less = less[word[less] == word[less + 1]]
            rank[less] = self._ranks(sym[less], sym[less + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([x for _, x in done])
        return sym[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class StreamEncoder:
    """Ids of one word whose bytes come in parts; holds a bounded number of bytes."""

    def __init__(self, table: MergeTable, block: int = 64):
        self.table, self.window = table, b""
        self.full = 2 * table.lookahead + max(table.length.values()) + block

    def feed(self, part: bytes) -> Iterator[int]:
        for at in range(0, len(part), self.table.lookahead):
            self.window += part[at : at + self.table.lookahead]
            if len(self.window) >= self.full:
                yield from self._emit(len(self.window) - self.table.lookahead)

    def _emit(self, stable: int) -> Iterator[int]:
        at, length = 0, self.table.length
        for t in self.table.merge([self.table.inner[b] for b in self.window]):
            if at + length[t] > stable:
                break
            at += length[t]
            yield t
        self.window = self.window[at:]

    def finish(self) -> list[int]:
        w, self.window = self.window, b""
        return self.table.merge([*(self.table.inner[b] for b in w[:-1]), self.table.last[w[-1]]]) if w else []


class StreamDecoder:
    """Text from ids, a few at a time; what is held is at most three bytes of a character that is not yet whole.

    ``pieces``: as the library decodes this file, which names no decoder: vocabulary strings with a space between.
    Else the words themselves: their bytes, a space after each word's end.  Broken sequences give U+FFFD.
    """

    def __init__(self, table: MergeTable, pieces: bool = False):
        self.table, self.held, self.begun = table, b"", False
        self.pieces = pieces
        self.flat, self.at = table.decoding(pieces)

    def bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that these ids add."""
        if not len(ids):
            return b""
        lo, n = self.at[ids], self.at[ids + 1] - self.at[ids]
        out = self.flat[np.repeat(lo - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
        # with pieces each one's table entry begins with the space, which the first of a text goes without
        skip, self.begun = int(self.pieces and not self.begun), True
        return out[skip:].tobytes()

    def feed(self, ids: Iterable[int]) -> str:
        return self._text(self.bytes(np.fromiter(ids, np.int64)))

    def _text(self, new: bytes) -> str:
        data = self.held + new
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                keep = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
                break
            if b < 0x80:
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class _Memo:
    """Ids of runs without white space, as little-endian bytes; emptied when full."""

    def __init__(self, table: MergeTable):
        self.table, self.runs, self.words = table, {}, {}

    def learn(self, runs: set[str]) -> None:
        """Afterwards ``self.runs`` has all of ``runs``; short words that are new are merged together, long ones pass a window."""
        if len(self.runs) + len(runs) > MEMO:
            self.runs = {}
            self.words = {}
        new = [r for r in runs if r not in self.runs]
        split = self.table.pieces.findall
        parts = [(r,) if r.isalpha() else (r[:-1], r[-1]) if r[-1] in ".,!|" and r[:-1].isalpha() else split(r) for r in new]
        words = [w for w in {w for p in parts for w in p} if w not in self.words]
        raw = [w.encode() for w in words]
        short = [i for i, w in enumerate(raw) if len(w) <= 48]
        ids, at = self.table.merge_many([raw[i] for i in short]) if short else ([], [0])
        data, at = np.asarray(ids).astype("<u4").tobytes(), list(at)
        for k, i in enumerate(short):
            self.words[words[i]] = data[4 * at[k] : 4 * at[k + 1]]
        for i, w in enumerate(raw):
            if len(w) > 48:
                stream = StreamEncoder(self.table)
                self.words[words[i]] = _packed([*stream.feed(w), *stream.finish()])
        for r, p in zip(new, parts):
            self.runs[r] = self.words[p[0]] if len(p) == 1 else b"".join(map(self.words.__getitem__, p))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def normalized(text: str) -> str:
    """NFC, then lower case character by character (a final sigma is no exception)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
    return text.lower()


def _runs(text: str) -> list[str]:
    text = normalized(text)
    return [x for x in BLANKS.split(text) if x] if ODD_BLANKS.search(text) else text.split()


class Transducer:
    """Ids of a text that comes in blocks, as little-endian bytes, each as soon as nothing that follows can change it."""

    def __init__(self, memo: _Memo):
        self.memo, self.table = memo, memo.table
        self.held = ""  # of a run without white space, not yet normalised
        self.word: StreamEncoder | None = None  # an open word of a long run
        self.rest = ""  # of a long run, normalised, behind the open word
        self.kind = ""  # of the open word: l letters, o other marks
        self.most = 0

    def feed(self, block: str) -> bytes:
        """``block`` must hold no special token."""
        text = self.held + block
        cut = max((m.end() for m in BLANKS.finditer(text, max(len(text) - RUN, 0))), default=0)
        if not cut and len(text) > RUN:
            cut = next((m.end() for m in regex.finditer("(?r)[" + WHITE + "]", text)), 0)
        out = [self._runs(text[:cut])] if cut else []
        self.held = text[cut:]
        if len(self.held) > RUN:
            out.append(self._long(self.held, False))
        self.most = max(self.most, len(self.held) + len(self.rest) + len(self.word.window if self.word else b""))
        return b"".join(out)

    def finish(self) -> bytes:
        text, self.held = self.held, ""
        return self._runs(text)

    def _runs(self, text: str) -> bytes:
        """Ids of a part that ends with a run's end; its first run may go on with a long one."""
        out = []
        if self.word or self.rest:
            m = BLANKS.search(text)
            end = m.start() if m else len(text)
            out = [self._long(text[:end], True)]
            text = text[end:]
        runs = _runs(text)
        long = [r for r in runs if len(r) > RUN]
        self.memo.learn({r for r in runs if len(r) <= RUN})
        if not long:
            return b"".join([*out, *map(self.memo.runs.__getitem__, runs)])
        for r in runs:
            out.append(self.memo.runs[r] if len(r) <= RUN else self._long(r, True, done=True))
        return b"".join(out)

    def _long(self, text: str, ends: bool, done: bool = False) -> bytes:
        """A part of a long run: its words go through the window but for what may still change; ``done``: it is normalised."""
        if not ends:
            # what stands before a safe character is normalised alike with and without what follows
            cut = next((m.start() for m in regex.finditer("(?r)" + _SAFE.pattern, text)), 0)
            text, self.held = text[:cut], text[cut:]
        out, buffer = [], self.rest + (text if done else normalized(text))
        at = 0
        if self.word is not None:
            more = regex.compile(r"\p{L}*" if self.kind == "l" else r"[^" + WHITE + r"\p{L}\p{N}]*").match(buffer)
            out += self.word.feed(more[0].encode())
            at = more.end()
            if at < len(buffer) or ends:
                out += self.word.finish()
                self.word = None
        if self.word is None:
            for m in self.table.pieces.finditer(buffer, at):
                if m.end() == len(buffer) and not ends:
                    # the last word may go on; a mark may begin a contraction, so three characters decide
                    if m.end() - m.start() > 3:
                        self.word, self.kind = StreamEncoder(self.table), "l" if m[0][-1].isalpha() else "o"
                        out += self.word.feed(m[0].encode())
                        at = m.end()
                    else:
                        at = m.start()
                    break
                stream = StreamEncoder(self.table)
                out += [*stream.feed(m[0].encode()), *stream.finish()]
                at = m.end()
        self.rest = "" if ends else buffer[at:]
        return _packed(out)


def id_blocks(memo: _Memo, text: str) -> Iterator[bytes]:
    """The ids of a text, block by block."""
    at = 0
    for m in [*(memo.table.split_special.finditer(text) if memo.table.split_special else ()), None]:
        end = m.start() if m else len(text)
        stream = Transducer(memo)
        for k in range(at, end, BLOCK):
            yield stream.feed(text[k : min(k + BLOCK, end)])
        yield stream.finish()
        if m:
            yield memo.table.special[m[0]].to_bytes(4, "little")
            at = m.end()


def _plain_runs(table: MergeTable, text: str) -> list[str] | None:
    """The runs of a text of one block without special tokens and long runs, None of any other."""
    if len(text) > BLOCK or (table.split_special and table.split_special.search(text)):
        return None
    runs = _runs(text)
    return runs if not runs or max(map(len, runs)) <= RUN else None


def encode_texts(path: str, texts: list[str], memo: _Memo | None = None) -> list[tuple[bytes, str]]:
    """Of each text: ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
    memo = memo or _Memo(merge_table(path))
    out = []
    for text in texts:
        ids = b"".join(id_blocks(memo, text))
        decoder = StreamDecoder(memo.table, pieces=True)
        out.append((ids, decoder.feed(np.frombuffer(ids, "<u4")) + decoder.finish()))
    return out


def encode(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``docs`` and n_tokens long, ids_sha256, decoded_sha256 string (and ids array<int> if asked).

    Columns of those names are replaced.  A null text counts as empty: no tokens, digests of nothing.  Rows are
    independent, so repeated rows and ids, ties and hot sources change nothing; an empty table gives an empty one.
    """
    new = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if keep_ids:
        new |= {"ids": T.ArrayType(T.IntegerType())}
    kept = [c for c in docs.columns if c.lower() not in new]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, v) for k, v in new.items()])

    def one(memo: _Memo, value: str, runs: list[str] | None) -> tuple:
        decoder, n, ids_sha, decoded_sha, whole = StreamDecoder(memo.table, pieces=True), 0, hashlib.sha256(), hashlib.sha256(), []
        for ids in id_blocks(memo, value) if runs is None else (b"".join(map(memo.runs.__getitem__, runs)),):
            n += len(ids) // 4
            ids_sha.update(ids)
            decoded_sha.update(decoder.bytes(np.frombuffer(ids, "<u4")))
            if keep_ids:
                whole.append(ids)
        return (n, ids_sha.hexdigest(), decoded_sha.hexdigest(), *([np.frombuffer(b"".join(whole), "<u4").astype(np.int32)] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memo's many small values hold no cycles
        try:
            memo = _Memo(merge_table(path))  # the task's own: it goes with the task
            for batch in text_pieces(batches, text):
                texts = string_rows(batch.column(batch.schema.get_field_index(text)))
                # of texts of one block the runs are looked up together, so that new words are merged together
                plain = [_plain_runs(memo.table, t) for t in texts]
                memo.learn({r for runs in plain if runs is not None for r in runs})
                rows = [one(memo, t, runs) for t, runs in zip(texts, plain)]
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + cols, names=[*kept, *new])
        finally:
            gc.enable()
            give_back()

    return docs.mapInArrow(run, schema)


def op10_bpe(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return encode(documents.select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
