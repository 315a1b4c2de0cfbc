"""Hierarchical packing of documents into token sequences of several lengths."""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.store import small_batches
from tessera.llm.textarrays import released

TIERS = (2048, 1024, 512, 256, 128, 64)
END = 1
STEP_TOKENS = 16 * 2048
ROUND_TOKENS = 2 << 20  # tokens that are packed together
SLICE = 1 << 20  # bytes of text that are cut into words together
KEPT_BYTES = 72 << 20  # what the words that a task knows may take, about
KEPT_BETWEEN = 8 << 20  # and those that a worker keeps for its next task
WORD_BYTES = 180  # of a word beside its characters: its entry, its numbers
MARK = "~"
MARKS = ".,;:!?*#$%&|"
LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+").fullmatch  # without the dotted capital I, which lowers to two characters
LOWERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}  # what stands for bytes that aren't printed
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, capacity long, step_group long"


def _joined(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``ids`` one after another, and where each begins (n + 1 bounds)."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.repeat(first - at[:-1], sizes) + np.arange(at[-1])], at


class _Words(dict):
    """Numbers of words in the order in which they were met; one that is unknown gets the next."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Encoder:
    """Ids of whole texts. Where the tokenizer allows it, each distinct word is tokenized once and then looked up.

    It does if it cuts at spaces and line feeds and drops them, and cuts marks at a word's end apart, so that no token
    depends on more than one word; that is probed when the file is read. Otherwise texts are encoded as they are.
    Words of Latin letters go to the model itself where the file's other steps do no more to them than to lower them.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None  # what stands between words that are tokenized in one go
        self.by_words = self._cuts_at_spaces()
        self.model = self.tokenizer.model if self._only_lowers(path) else None
        self._clear()

    def _cuts_at_spaces(self) -> bool:
        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        words = ["Alpha", "beta", "it's", "1234", "Größe", "日本語", "x1", "naïve"]
        spaced = [" ".join(words), "  ".join(words), "\n".join(words), f" {words[0]}\n\n{' '.join(words[1:])} "]
        joined = [i for w in words for i in ids(w)]
        parted = all(ids(w + m) == ids(w) + ids(m) for w in words for m in [*MARKS, MARKS[:3], "!!", "?!.", "$%"])
        return all(ids(t) == joined for t in spaced) and parted and not ids(" ") and not ids("\n")

    def _only_lowers(self, path: str) -> bool:
        """Is a run of letters up to U+017F, but for the dotted capital I, one piece for the model, as its lowered bytes?"""
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        return (
            steps["normalizer"] == LOWERS
            and steps["pre_tokenizer"] == SPLITS
            and steps["model"]["type"] == "BPE"
            and not steps["model"].get("dropout")
            and not any(LETTERS(x["content"]) for x in steps["added_tokens"])
            and not any(steps[x] for x in ("truncation", "padding", "post_processor"))
        )

    def _clear(self) -> None:
        self.known = _Words({"": 0})
        self.ids = np.zeros(0, np.uint32)
        self.first, self.length = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.uses = np.zeros(1, np.int64)
        self.held = 0

    def trim(self, most: int) -> None:
        """Forget all but the words used most, up to so many bytes."""
        if self.held <= most:
            return
        names = list(self.known)
        order = np.argsort(-self.uses[1:], kind="stable") + 1
        cost = np.array([len(w) for w in names], np.int64) + WORD_BYTES + 4 * self.length
        kept = order[np.cumsum(cost[order]) <= most]
        ids, at = self._gather(kept)
        words, uses = " ".join([names[k] for k in kept.tolist()]), self.uses[kept]
        self._clear()
        del names  # new strings lie together, so that the memory of the others can go
        self.known.update(zip(words.split(" ") if len(kept) else [], range(1, len(kept) + 1), strict=True))
        self._keep(at[:-1], np.diff(at), ids, sum(map(len, self.known)))
        self.uses[1:] = uses // 2

    def _keep(self, first: np.ndarray, length: np.ndarray, ids: np.ndarray, n_chars: int) -> None:
        """More ids, and where among all of them the next words' begin."""
        self.first, self.length = np.concatenate([self.first, first]), np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(length), np.int64)])
        self.held += n_chars + WORD_BYTES * len(length) + 4 * len(ids)

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after another, and where each word's begin."""
        return _joined(self.ids, self.first[which], self.length[which])

    def _tokenize(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has: those of letters by the model, others
        together in one go, apart from those that hold the mark themselves."""
        lettered = np.fromiter((LETTERS(w) is not None for w in words), bool, len(words)) if self.model else np.zeros(len(words), bool)
        marked = np.fromiter((self.mark is None or MARK in w for w in words), bool, len(words))
        lengths, ids, order = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if lettered.any():
            tokenize = self.model.tokenize
            own = np.flatnonzero(lettered)
            low = [words[k].lower() for k in own.tolist()]
            found = [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTES))] for w in low]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
            order.append(own)
        plain = np.flatnonzero(~lettered & ~marked)
        for i in range(0, len(plain), 8192):
            part = [words[k] for k in plain[i : i + 8192].tolist()]
            found = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(found == self.mark)
            lengths.append(np.diff(np.append(at, len(found)), prepend=-1) - 1)
            ids.append(np.delete(found, at))
            order.append(plain[i : i + 8192])
        for k in np.flatnonzero(~lettered & marked).tolist():
            found = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint32)
            lengths.append(np.array([len(found)]))
            ids.append(found)
            order.append(np.array([k]))
        sizes, every = np.concatenate(lengths), np.concatenate(ids)
        back = np.argsort(np.concatenate(order))
        return _joined(every, (np.cumsum(sizes) - sizes)[back], sizes[back])[0], sizes[back]

    def _learn(self, n: int) -> None:
        """The words from number n on. One that ends in marks is its stem and its marks, which are cut apart anyway."""
        words, known = list(itertools.islice(self.known, n, None)), self.known
        parted, pieces = [], []
        for k, w in enumerate(words):
            if w[-1] in MARKS:
                stem = w.rstrip(MARKS)
                if stem and stem[-1].isalnum():
                    parted.append(k)
                    pieces += (known[stem], known[w[len(stem) :]])
        words += itertools.islice(known, n + len(words), None)
        whole = np.ones(len(words), bool)
        whole[parted] = False
        whole = np.flatnonzero(whole)
        ids, sizes = self._tokenize([words[k] for k in whole.tolist()])
        first, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[whole], length[whole] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        if parted:  # their pieces are known before or among the whole ones
            every, of = np.concatenate([self.ids, ids]), np.array(pieces)
            more, at = _joined(every, np.concatenate([self.first, first])[of], np.concatenate([self.length, length])[of])
            first[parted], length[parted] = len(every) + at[:-1:2], np.diff(at[::2])
            ids = np.concatenate([ids, more])
        self._keep(first, length, ids, sum(map(len, words)))

    def texts(self, column: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with ``end``, and n + 1 bounds."""
        if not self.by_words:
            return self._whole(column, end)
        words: list[str] = []
        counts = np.zeros(len(column) + 1, np.int64)
        for k, text in enumerate(column.to_pylist()):
            if text:
                own = text.replace("\n", " ").split(" ")
                words += own
                counts[k + 1] = len(own)
        if self.held > KEPT_BYTES:
            self.trim(KEPT_BYTES // 2)
        n = len(self.known)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > n:
            self._learn(n)
        self.uses += np.bincount(which, minlength=len(self.uses))
        ids, at = self._gather(which)
        bounds = at[np.cumsum(counts)] + np.arange(len(column) + 1)
        out = np.full(int(bounds[-1]), end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = ids
        return out, bounds

    def _whole(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        found = [[*self.tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in column.to_pylist()]
        return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])])


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for each worker process: the words that a task has met are known to the next."""
    return Encoder(path)


class Packer:
    """Packs the documents of one task.

    A document longer than the longest tier gives whole windows; its rest, like any shorter document, is routed to
    the smallest tier that holds it. Each tier's windows are opened by its own pieces, longest tier first; the gap
    of a window is filled with the largest pieces of shorter tiers that fit, and a last one is cut to close it.
    """

    def __init__(self, task: int, tiers: tuple[int, ...], step_tokens: int) -> None:
        if list(tiers) != sorted(tiers, reverse=True) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two, longest first")
        self.base, self.tiers, self.step_tokens = task << 33, tiers, step_tokens
        self.sequences = self.steps = self.tokens = 0
        self.pools: dict[int, list[tuple]] = {}
        self.mask = 0
        self.windows: list[tuple[int, list[tuple]]] = []

    def put(self, piece: tuple) -> None:
        """piece: (doc_id, ids of the document, start, length)."""
        n = piece[3]
        self.pools.setdefault(n, []).append(piece)
        self.mask |= 1 << n

    def take(self, most: int) -> tuple | None:
        """The longest piece of at most so many tokens."""
        n = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n <= 0:
            return None
        piece = self.pools[n].pop()
        if not self.pools[n]:
            self.mask &= ~(1 << n)
        return piece

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, n = self.tiers[0], len(ids)
        for start in range(0, n - n % top, top):
            self.windows.append((top, [(doc_id, ids, start, top)]))
        if n % top:
            self.put((doc_id, ids, n - n % top, n % top))
        self.tokens += n

    def close(self, final: bool) -> Iterator[tuple]:
        """Pack what is pooled; what can't fill a window waits for more, or at the end fills ever shorter ones."""
        left: list[tuple] = []
        for t, tier in enumerate(self.tiers):
            shortest = self.tiers[t + 1] if t + 1 < len(self.tiers) else 0
            while (n := self.mask.bit_length() - 1) > shortest:
                row = [self.take(n)]
                gap = tier - n
                while gap:
                    piece = self.take(gap)
                    if piece is None:
                        if (piece := self.take(tier)) is None:
                            break
                        doc_id, ids, start, length = piece
                        self.put((doc_id, ids, start + gap, length - gap))
                        piece = (doc_id, ids, start, gap)
                    row.append(piece)
                    gap -= piece[3]
                if gap:
                    left += row
                else:
                    self.windows.append((tier, row))
        if not final:
            for piece in left:
                self.put(piece)
        elif left:
            rest = sum(x[3] for x in left)
            for capacity in [*[t for t in self.tiers if t <= rest], 0]:
                while capacity and rest >= capacity:
                    row, gap = [], capacity
                    while gap:
                        doc_id, ids, start, length = left.pop()
                        used = min(gap, length)
                        row.append((doc_id, ids, start, used))
                        if length > used:
                            left.append((doc_id, ids, start + used, length - used))
                        gap -= used
                    self.windows.append((capacity, row))
                    rest -= capacity
            if left:
                self.windows.append((self.tiers[0] if rest & (rest - 1) else rest, left))
        yield from self._emit()
        self.tokens = 0

    def _emit(self) -> Iterator[tuple]:
        """Windows in groups of about equal token capacity, the longest dealt first to the emptiest group."""
        total = sum(c for c, _ in self.windows)
        groups = [(0, g) for g in range(max(1, round(total / self.step_tokens)))]
        for capacity, row in sorted(self.windows, key=lambda x: -x[0]):
            load, group = heapq.heappop(groups)
            heapq.heappush(groups, (load + capacity, group))
            offset = 0
            for doc_id, ids, start, length in row:
                yield doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), self.base + self.sequences, offset, capacity, self.base + self.steps + group
                offset += length
            self.sequences += 1
        self.steps += len(groups)
        self.windows = []


def _slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    first = 0
    while first < len(column):
        last = min(len(column), max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1))
        yield first, last
        first = last


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces of all documents of (doc_id, text, ...): ``SCHEMA``; ``ids`` are little-endian 32-bit.

    Each id of each document is in exactly one piece, and pieces fill their sequences from 0 without gaps. Every
    sequence is full at one of the tiers, but for one at the end of each task that may be padded to the longest. Tasks
    pack by themselves: nothing is shuffled, no document is gathered with another, and what is held at a time is
    bounded by ``ROUND_TOKENS`` and the longest document. ``tokenizer`` is a file that every executor can read.

    A null text is an empty one: its only id is the end mark. Very long texts are cut into whole windows and a rest;
    pieces of equal length are taken the last come first. Repeated rows are packed as often as they occur, doc_id
    may be null, columns other than doc_id and text play no part, whatever their names, and no rows give no pieces.
    """
    small_batches(docs.sparkSession)
    fields = [x.split() for x in SCHEMA.split(", ")]
    schema = pa.schema([(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in fields])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = None, Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        waiting: list[tuple] = []
        size = 0

        def out(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, size
            for piece in pieces:
                waiting.append(piece)
                size += piece[2]
                if size >= 1 << 20:
                    yield table(waiting)
                    waiting, size = [], 0

        for batch in batches:
            encoder = encoder or _encoder(tokenizer)
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for first, last in _slices(texts):
                ids, bounds = encoder.texts(texts.slice(first, last - first))
                for k in range(first, last):
                    packer.add(doc_ids[k], ids[bounds[k - first] : bounds[k - first + 1]])
                if packer.tokens >= ROUND_TOKENS:
                    yield from out(packer.close(False))
        yield from out(packer.close(True))
        if waiting:
            yield table(waiting)
        if encoder:
            encoder.trim(KEPT_BETWEEN)
        released()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
