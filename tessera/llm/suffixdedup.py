"""Removal of repeated byte strings through suffix buckets sorted with difference-cover ranks.

A string of ``LENGTH`` bytes is removed wherever it isn't the first of its kind. Suffixes that can't repeat are left
out first: each window of LENGTH bytes has an anchor, the least hashed gram in it, and equal windows have equal
anchors at equal places, so only windows whose anchor's gram occurs again are candidates. They go, with the text around
them, to suffix buckets by their anchor's gram. In a bucket the suffixes are sorted block by block; ties beyond the
first 16 bytes are resolved by ranks that were computed for a difference-cover sample of the positions only. Runs of
neighbours with a common prefix of LENGTH bytes are the repeats; the bytes themselves are compared, not hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import small_batches
from tessera.llm.textarrays import BASE, POWERS, U64, mix64, released, slices, utf8

LENGTH = 100
GRAM = 28
COVER, PERIOD = (0, 1, 3, 9), 13  # every difference modulo 13 is one of two members
CHUNK_BYTES = 3 << 20  # text that a task holds at a time
GRAM_BUCKET_BYTES, SUFFIX_BUCKET_BYTES = 32 << 20, 2 << 20  # text of the corpus for each bucket
BLOCK_BYTES = 1 << 19  # text of a bucket that is compared together
FINER = (24, 8, 1)  # windows of a run where those with one gram are more text than that
SORTED_AT_ONCE = 1 << 18  # suffixes of one block
SCAN = 1 << 18

_HEAD = np.dtype([("doc", "<i8"), ("idx", "<u4"), ("start", "<u4"), ("n", "<u2"), ("off", "<u2")])
_RUN = np.dtype([("idx", "<u4"), ("start", "<u4"), ("n", "<u4")])
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SHIFT = np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])


def _windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: first start, number of windows, anchor place, gram hash.

    The anchor is the gram with the least 32-bit hash in the window, the rightmost of equals.
    """
    width = length - GRAM + 1
    valid = np.zeros(len(data) + 1, np.int8)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[:-1][long] + sizes[long] - length + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(data), SCAN):
        ok = valid[at : at + SCAN]
        if not ok.any():
            continue
        piece = data[at : at + SCAN + length - 1]
        n = len(piece)
        if n < length:
            continue
        up, down = POWERS.upto(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((piece.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        least = (grams & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(len(grams), dtype=U64))
        covered = 1
        while covered * 2 <= width:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        if width > covered:
            least = np.minimum(least[: -(width - covered)], least[width - covered :])
        place = (U64(0xFFFFFFFF) - (least & U64(0xFFFFFFFF))).astype(np.int64)
        starts = np.flatnonzero(ok[: len(place)])
        place = place[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(starts)))
        found.append((starts[first] + at, count, place[first] + at, grams[place[first]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ordered(table: pa.Table) -> pa.Table:
    """The documents of a chunk in the order that decides which occurrence is first; null doc_id comes last."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _doc_keys(table: pa.Table) -> np.ndarray:
    top = np.iinfo(np.int64).max
    return np.array([top if x is None else x for x in table["doc_id"].to_pylist()], np.int64)


def _alone(work):
    """``work`` on a group, giving back the memory that it took."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = work(key, table)
        released()
        return out

    return run


def _paired(work):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(key, left, right)
        released()
        return out

    return run


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part


def _grams_of(length: int, n_buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("twice", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        data, offsets = utf8(_ordered(table)["text"])
        _, _, place, grams = _windows(data, offsets, length)
        fresh = np.ones(len(place), bool)
        fresh[1:] = place[1:] != place[:-1]
        grams, count = np.unique(grams[fresh], return_counts=True)
        rows = [(b, chunk, grams[p].tobytes(), (count[p] > 1).tobytes()) for b, p in _by_bucket((grams % U64(n_buckets)).astype(np.int64))]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    return run


def _repeated_grams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    grams = [np.frombuffer(x, U64) for x in table["grams"].to_pylist()]
    twice = np.concatenate([np.frombuffer(x, bool) for x in table["twice"].to_pylist()])
    which = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
    everything = np.concatenate(grams)
    _, back, count = np.unique(everything, return_inverse=True, return_counts=True)
    count = count + np.bincount(back, twice).astype(np.int64)
    again = count[back] > 1
    bounds = np.searchsorted(which[again], np.arange(len(grams) + 1))
    kept = everything[again]
    rows = [(c, kept[a:b].tobytes()) for c, a, b in zip(table["chunk"].to_pylist(), bounds[:-1], bounds[1:], strict=True) if b > a]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "grams": pa.array([r[1] for r in rows], pa.binary())})


def _contexts_of(length: int, n_buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("heads", pa.binary()), ("texts", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(left) and len(right):
            chunk = left["__chunk"][0].as_py()
            left = _ordered(left)
            doc_keys = _doc_keys(left)
            data, offsets = utf8(left["text"])
            starts, count, place, grams = _windows(data, offsets, length)
            again = np.sort(np.concatenate([np.frombuffer(x, U64) for x in right["grams"].to_pylist()]))
            at = np.minimum(np.searchsorted(again, grams), len(again) - 1)
            keep = np.flatnonzero(again[at] == grams)
            starts, count, place, grams = starts[keep], count[keep], place[keep], grams[keep]
            idx = np.searchsorted(offsets, starts, "right") - 1
            heads = np.zeros(len(starts), _HEAD)
            heads["doc"], heads["idx"], heads["start"] = doc_keys[idx], idx, starts - offsets[idx]
            heads["n"], heads["off"] = count, place - starts
            raw = data.tobytes()
            ends = (starts + count + length - 1).tolist()
            texts = [raw[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
            first: dict[tuple[bytes, int], int] = {}
            later = np.array([first.setdefault((t, o), k) != k for k, (t, o) in enumerate(zip(texts, heads["off"].tolist(), strict=True))], bool)
            # equal contexts of one chunk: all but the first repeat it, whatever other chunks hold
            known = np.flatnonzero(later)
            if len(known):
                runs = np.zeros(len(known), _RUN)
                runs["idx"], runs["start"], runs["n"] = idx[known], heads["start"][known], count[known]
                rows.append((-1 - chunk, chunk, runs.tobytes(), b""))
            sent = np.flatnonzero(~later)
            for b, p in _by_bucket((grams[sent] % U64(n_buckets)).astype(np.int64)):
                p = sent[p]
                rows.append((b, chunk, heads[p].tobytes(), b"".join([texts[k] for k in p.tolist()])))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    return run


def _words64(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number that orders like them; zeros beyond the end."""
    w = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    w = (w[:-1] << U64(8)) | w[1:]
    w = (w[:-2] << U64(16)) | w[2:]
    w = (w[:-4] << U64(32)) | w[4:]
    return w[: len(text)]


def _ranked(key: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal keys have equal ranks."""
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), np.int64)
    if len(key):
        out[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return out


def _tied(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items whose key isn't theirs alone, in order of their keys, and their ranks."""
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(key), bool)
    shared[1:] = same
    shared[:-1] |= same
    order, ordered = order[shared], ordered[shared]
    return order, np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)


def _cover_ranks(words: np.ndarray, sample: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the sample suffixes by at least ``length`` bytes, at their places in an array over all positions.

    Steps of the cover's period lead from sample to sample, so ranks double their depth from those of the sample alone.
    """
    ranks = np.zeros(len(words) + 1, np.int64)
    own = _ranked((_ranked(words[sample]) << 32) | _ranked(words[sample + PERIOD - 8]))
    depth = PERIOD
    while depth < length and len(own) and own.max() < len(own):
        ranks[sample] = own
        ahead = sample + depth
        own = _ranked((own << 32) | np.where(ahead < ends, ranks[np.minimum(ahead, len(words))], 0))
        depth *= 2
    ranks[sample] = own
    return ranks


class _Runs(NamedTuple):
    """Neighbouring windows with one anchor: where their text begins, how many they are, how far the first lies before
    the anchor, its rank among all windows, and its place in the answer."""

    at: np.ndarray
    n: np.ndarray
    off: np.ndarray
    rank: np.ndarray
    slot: np.ndarray

    def part(self, which: np.ndarray) -> _Runs:
        return _Runs(*(x[which] for x in self))


def _cut_apart(runs: _Runs, width: int) -> _Runs:
    """Runs whose windows begin in one stretch of ``width`` places before the anchor."""
    last = runs.off - runs.n + 1
    pieces = runs.off // width - last // width + 1
    of = np.repeat(np.arange(len(pieces)), pieces)
    stretch = runs.off[of] // width - (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    off = np.minimum(runs.off[of], stretch * width + width - 1)
    ahead = runs.off[of] - off
    return _Runs(runs.at[of] + ahead, off - np.maximum(last[of], stretch * width) + 1, off, runs.rank[of] + ahead, runs.slot[of] + ahead)


def _common(runs: _Runs, text: np.ndarray, width: int, length: int) -> np.ndarray:
    """Hashes of the bytes that all windows in a run's stretch hold: equal windows have equal ones."""
    stretch = runs.off // width
    at = runs.at + runs.off - stretch * width
    out = stretch.astype(U64)
    for k in range(length - width + 1):
        out = out * U64(BASE) + text[at + k]
    return mix64(out)


def _settle(runs: _Runs, text: np.ndarray, length: int, widths: list[int], out: np.ndarray) -> None:
    """Compare the runs in blocks of about ``BLOCK_BYTES``; what has to meet but is more is cut into finer runs."""
    key = _common(runs, text, widths[0], length)
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
    size = np.concatenate([[0], np.cumsum(runs.n[order] + length - 1)])[first]
    for a, b in slices(size, BLOCK_BYTES):
        own = runs.part(order[first[a] : first[b]])
        if size[b] - size[a] <= BLOCK_BYTES or len(widths) == 1:
            _sort(own, text, length, out)
            continue
        own = _cut_apart(own, widths[1])
        own = own.part(np.argsort(own.rank))
        ends = own.at + own.n + length - 1
        known: dict[int, dict[bytes, int]] = {}
        fresh = np.ones(len(own.at), bool)
        for k, (x, y, o) in enumerate(zip(own.at.tolist(), ends.tolist(), own.off.tolist(), strict=True)):
            fresh[k] = known.setdefault(o, {}).setdefault(text[x:y].tobytes(), k) == k
        for x, n in zip(own.slot[~fresh].tolist(), own.n[~fresh].tolist(), strict=True):
            out[x : x + n] = True  # the same windows in the same order as those of a run before
        _settle(own.part(np.flatnonzero(fresh)), text, length, widths[1:], out)


def repeats(heads: np.ndarray, chunks: np.ndarray, text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of the contexts, one after another: is there an equal window of smaller rank in this bucket?

    ``text`` holds the contexts (n + length - 1 bytes each) one after another.
    """
    n = heads["n"].astype(np.int64)
    order_of = np.empty(len(heads), np.int64)
    order_of[np.lexsort((heads["start"], heads["idx"], chunks, heads["doc"]))] = np.arange(len(heads))
    sizes = n + length - 1
    runs = _Runs(np.cumsum(sizes) - sizes, n, heads["off"].astype(np.int64), order_of << 16, np.cumsum(n) - n)
    out = np.zeros(int(n.sum()), bool)
    widest = length - GRAM + 1  # then the common bytes are the anchor's gram
    _settle(runs, text, length, [widest, *(w for w in FINER if w < widest)], out)
    return out


def _sort(runs: _Runs, text: np.ndarray, length: int, out: np.ndarray) -> None:
    """Mark the windows that equal one of smaller rank in these runs."""
    n, off = runs.n, runs.off
    sizes = n + length - 1
    pad = 16
    base = np.concatenate([[0], np.cumsum(sizes + pad)])
    padded = np.zeros(int(base[-1]), np.uint8)
    context = np.repeat(np.arange(len(n)), sizes)
    within = np.arange(len(context)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = base[context] + within
    padded[places] = text[runs.at[context] + within]
    words = _words64(padded)
    residue = (within - off[context]) % PERIOD
    starts = np.flatnonzero(within < n[context])
    # a window that repeats has its first 16 and last 8 bytes in common with another at its place in the period
    at = places[starts]
    ends = mix64(words[at]) + mix64(words[at + 8] * U64(3)) + mix64(words[at + length - 8] * U64(5)) + residue[starts].astype(U64)
    starts = starts[np.sort(_tied(ends)[0])]
    used = np.zeros(len(n), bool)
    used[context[starts]] = True
    in_sample = np.flatnonzero(_IN_COVER[residue] & used[context])
    ranks = _cover_ranks(words, places[in_sample], (base[:-1] + sizes)[context[in_sample]], length)
    suffix, owner, residue, offset = places[starts], context[starts], residue[starts], within[starts]
    del context, within, places, in_sample, starts, at, ends

    rank = runs.rank[owner] + offset
    found = np.zeros(len(suffix), bool)
    blocks = max(1, math.ceil(len(suffix) / SORTED_AT_ONCE))
    head = words[suffix]
    if blocks > 1:
        splitters = np.sort(head[:: max(1, len(head) // (blocks * 64))])[64::64]
        block = np.searchsorted(splitters, head, "right")
    for b in range(blocks + 1 if blocks > 1 else 1):
        own = np.flatnonzero(block == b) if blocks > 1 else np.arange(len(suffix))
        if len(own) < 2:
            continue
        # by 8 bytes, then 16, where what is alone falls out; then by place in the cover's period and the cover's rank
        order, group = _tied(head[own])
        own = own[order]
        order, group = _tied((group << 32) | _ranked(words[suffix[own] + 8]))
        own = own[order]
        if not len(own):
            continue
        order = np.argsort((group << 32) | _ranked((residue[own] << 40) | ranks[suffix[own] + _SHIFT[residue[own]]]))
        own, group = own[order], group[order]
        at = suffix[own]
        near = np.flatnonzero((group[1:] == group[:-1]) & (residue[own[1:]] == residue[own[:-1]]))
        for ahead in [*range(16, length - 8, 8), length - 8]:
            near = near[words[at[near] + ahead] == words[at[near + 1] + ahead]]
        joined = np.zeros(len(own), bool)
        joined[near + 1] = True
        first = np.flatnonzero(~joined)
        ordered = rank[own]
        least = np.minimum.reduceat(ordered, first)
        found[own] = ordered > np.repeat(least, np.diff(np.append(first, len(own))))
    out[(runs.slot[owner] + offset)[found]] = True


def _sorted_bucket(length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if key[0].as_py() < 0:
            out = list(zip(table["chunk"].to_pylist(), table["heads"].to_pylist(), strict=True))
        else:
            parts = [np.frombuffer(x, _HEAD) for x in table["heads"].to_pylist()]
            heads = np.concatenate(parts)
            chunks = np.repeat(np.array(table["chunk"].to_pylist(), np.int64), [len(x) for x in parts])
            text = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint8)
            flags = repeats(heads, chunks, text, length)
            ends = np.cumsum(heads["n"], dtype=np.int64)
            on = np.flatnonzero(flags)
            if len(on):
                owner = np.searchsorted(ends, on, "right")
                fresh = np.ones(len(on), bool)
                fresh[1:] = (on[1:] != on[:-1] + 1) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(fresh)
                owner = owner[first]
                runs = np.zeros(len(first), _RUN)
                runs["idx"] = heads["idx"][owner]
                runs["start"] = heads["start"][owner] + on[first] - (ends - heads["n"])[owner]
                runs["n"] = np.diff(np.append(first, len(on)))
                for chunk, p in _by_bucket(chunks[owner]):
                    out.append((chunk, runs[p].tobytes()))
        return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "runs": pa.array([r[1] for r in out], pa.binary())})

    return run


def _removed(schema: pa.Schema, length: int, as_text: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        left = _ordered(left)
        data, offsets = utf8(left["text"])
        n = len(data)
        edge = np.zeros(n + 1, np.int32)
        for raw in right["runs"].to_pylist():
            runs = np.frombuffer(raw, _RUN)
            starts = offsets[runs["idx"]] + runs["start"]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + runs["n"] + length - 1, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        del edge
        before = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(gone, out=before[1:], dtype=before.dtype)
        opens = gone.copy()
        inner = offsets[1:-1][offsets[1:-1] < n]
        opens[1:] &= ~gone[:-1]
        opens[inner] = gone[inner]
        first = np.flatnonzero(opens)
        closes = gone.copy()
        closes[:-1] &= ~gone[1:]
        closes[inner - 1] = gone[inner - 1]
        last = np.flatnonzero(closes) + 1
        sizes = np.diff(offsets)
        of = np.searchsorted(first, offsets)
        removed = before[offsets[1:]] - before[offsets[:-1]]
        owner = np.repeat(np.arange(len(left)), np.diff(of))
        spans = pa.ListArray.from_arrays(
            pa.array(of, pa.int32()), pa.StructArray.from_arrays([pa.array(first - offsets[owner], pa.int64()), pa.array(last - offsets[owner], pa.int64())], ["start", "end"])
        )
        kept = data[~gone].tobytes()
        cuts = (offsets - before[offsets]).tolist()
        parts = [kept[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        new = {"n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(np.diff(of), pa.int64()), "spans": spans.cast(spans_type), "kept": pa.array(parts, pa.binary())}
        if as_text:
            nulls = left["text"].is_null().to_pylist()
            left = left.set_column(left.schema.get_field_index("text"), "text", pa.array([None if z else p.decode("utf-8", "ignore") for z, p in zip(nulls, parts, strict=True)], pa.string()))
        columns = [new[f.name] if f.name in new else left[f.name].cast(f.type) for f in schema]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


RESULT = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]


def dedup(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes, n_removed, n_spans, spans (byte ranges removed) and kept (bytes).

    Each byte of a text that lies in a string of ``length`` bytes which also starts earlier is removed; earlier is a
    smaller doc_id, or the same document further left. Strings are judged on the input and end with their document.
    With ``as_text`` the column text is what is kept, without characters of which only a part is.

    Null text is empty; texts shorter than ``length`` are whole; overlapping repeats count. A null doc_id is later
    than all others; rows with equal doc_id follow each other in a fixed order, so repeated rows repeat the first.
    Extra columns are carried, those named like a result column give way. No rows give no rows.

    A chunk of about ``CHUNK_BYTES`` of text is a task's largest group of documents, by a hash of the whole row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    docs = docs.drop(*RESULT)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, math.ceil(total / CHUNK_BYTES))
    n_grams, n_suffixes = max(1, math.ceil(total / GRAM_BUCKET_BYTES)), max(1, math.ceil(total / SUFFIX_BUCKET_BYTES))
    docs = docs.withColumn("__chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)))
    by_chunk = docs.groupBy("__chunk")
    grams = by_chunk.applyInArrow(_alone(_grams_of(length, n_grams)), "bucket long, chunk long, grams binary, twice binary")
    again = grams.groupBy("bucket").applyInArrow(_alone(_repeated_grams), "chunk long, grams binary")
    contexts = docs.groupBy("__chunk").cogroup(again.groupBy("chunk")).applyInArrow(_paired(_contexts_of(length, n_suffixes)), "bucket long, chunk long, heads binary, texts binary")
    runs = contexts.groupBy("bucket").applyInArrow(_alone(_sorted_bucket(length)), "chunk long, runs binary")
    new = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
    out = T.StructType([*docs.drop("__chunk").schema.fields, *new.fields])
    return docs.groupBy("__chunk").cogroup(runs.groupBy("chunk")).applyInArrow(_paired(_removed(to_arrow_schema(out), length, as_text)), out)


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with shortened texts and, where there is such a column, their new n_chars."""
    out = dedup(docs, length, as_text=True).drop(*RESULT)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
