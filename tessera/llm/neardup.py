"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

The signature of a text holds one consistent weighted sample of its shingles for each of BANDS * ROWS hash functions;
two texts share a sample with a probability equal to their weighted Jaccard similarity. Texts that share a whole band
are candidates, and links are those whose weighted Jaccard similarity, computed on all shingles, reaches the threshold.
Small buckets have all their pairs verified. Large ones have a few likely pairs verified first; then each text outside
a bucket's largest component is compared with all texts of other components, block against block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import small_batches, written
from tessera.llm.textarrays import U64, bags, mix64, released, slices, utf8

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4  # a pair at 0.8 shares a band with probability 0.998
#: A shingle is frequent from this share of all documents on; all rarer ones weigh the same.
FREQUENT = 1e-3
#: Frequent shingles are at most so many: where documents are so long that there could be more, the share rises.
MOST_FREQUENT = 1 << 20
DRAWS = 1 << 16
#: Candidates whose 48 samples agree less aren't verified: six standard errors below SIMILARITY.
ESTIMATE = 0.45
LIKELY = 0.85
PAIRWISE = 32  # texts of a bucket up to which all pairs are verified one by one
PAIRS = 2  # leaders that a text of a larger bucket is compared with at first
GROUP = 1024  # texts of a larger bucket that are looked at together for that
BLOCK = 1 << 19  # shingles of a block
COLUMNS = 1024  # shingles that a block's matrices hold at a time
CHUNK_SHINGLES = 1 << 20
HOT = 100_000  # rows of one key from which on a join spreads it
SPREAD = 64
_KEYS = (np.random.default_rng(20).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) << U64(1)) | U64(1)


@dataclass(frozen=True)
class Idf:
    """Frequent shingles in ascending order with their weights; all others weigh ``rare``."""

    shingles: np.ndarray
    weights: np.ndarray
    rare: float = 1 + math.log(1 / FREQUENT)

    def of(self, found: np.ndarray) -> np.ndarray:
        out = np.full(len(found), self.rare)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
            hit = self.shingles[at] == found
            out[hit] = self.weights[at[hit]]
        return out


def _often(words: int):
    """(shingle, df) of what occurs in half of FREQUENT of a chunk's documents, and (null, how many there were in all)."""
    schema = pa.schema([("shingle", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = n = 0

        def report() -> pa.RecordBatch:
            nonlocal held, size, n
            everything = np.concatenate(held)
            everything.sort()
            first = np.flatnonzero(np.concatenate([[True], everything[1:] != everything[:-1]]))
            times = np.diff(np.append(first, len(everything)))
            often = times >= max(1, math.ceil(FREQUENT * n / 2))
            found = everything[first[often]].view(np.int64)
            columns = [pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(found)]), pa.concat_arrays([pa.array([size], pa.int64()), pa.array(times[often])])]
            rows = pa.RecordBatch.from_arrays(columns, schema=schema)
            held, size, n = [], 0, 0
            return rows

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                found, _, _ = bags(data[part[0] : part[-1]], part - part[0], words)
                if len(found):
                    held.append(found)
                size, n = size + len(found), n + last - first
                if size >= CHUNK_SHINGLES:
                    yield report()
        if held:
            yield report()
        released()

    return run


def _families(shared, words: int):
    """Distinct (shingle, least shingle of a text that holds it), for the frequent shingles."""
    schema = pa.schema([("shingle", pa.int64()), ("least", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frequent = shared.value
            data, offsets = utf8(batch.column(0))
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                found, _, bounds = bags(data[part[0] : part[-1]], part - part[0], words)
                if not len(found):
                    continue
                least = np.repeat(found[np.minimum(bounds[:-1], len(found) - 1)], np.diff(bounds))
                at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                hit = frequent[at] == found
                found, least = found[hit], least[hit]
                order = np.lexsort((least, found))
                found, least = found[order], least[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (least[1:] != least[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)) for x in (found, least)], schema=schema)
        released()

    return run


def fit_idf(docs: DataFrame, text: str = "text", words: int = WORDS) -> Idf:
    """Weights 1 + log(documents / frequency) of the frequent shingles, from all documents; however files are cut.

    Frequent are shingles in a share FREQUENT of the documents. Chunks report what is in half of that share of
    theirs, so every frequent shingle's reported sum is at least half its count, and those that reach that are at most
    twice (shingles of a document) / FREQUENT, and never more than 2 * MOST_FREQUENT: that bounds what the driver
    collects and shares. A second pass counts them exactly.

    The frequency is the number of families, not of documents: texts with the same least shingle hash are one
    family, as near copies mostly are. Else a group of near copies that is itself a large share of the corpus would make
    its own text worthless and its few edits all that counts.
    """
    total = docs.count()
    counted = written(docs.select(text).mapInArrow(_often(words), "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df")))
    everything = (counted.where("shingle is null").agg(F.sum("df")).first()[0] or 0) / max(total, 1)
    share = max(FREQUENT, everything / MOST_FREQUENT)
    least = max(2.0, share * total)
    top = math.log(max(1.0, min(1 / share, total)))
    frequent = counted.where(F.col("shingle").isNotNull() & (F.col("df") >= least / 2)).select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64)
    frequent = np.sort(frequent)
    if not len(frequent):
        return Idf(frequent, np.zeros(0), 1 + top)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    pairs = docs.select(text).mapInArrow(_families(shared, words), "shingle long, least long")
    rows = pairs.distinct().groupBy("shingle").agg(F.count("*").alias("n")).toArrow()
    shared.destroy()
    shingles = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    weights = 1 + np.minimum(np.log(total / rows["n"].to_numpy()[order]), top)
    return Idf(shingles[order], weights, 1 + top)


class Sampler:
    """Improved consistent weighted sampling with r, c ~ Gamma(2, 1) and b ~ U(0, 1).

    The variates of a shingle for the k-th function are those of the draw that a multiplicative hash of the shingle
    picks, so each costs one look-up; for the weight that most shingles have, so does the whole expression.
    """

    def __init__(self, idf: Idf, keys: np.ndarray = _KEYS) -> None:
        rng = np.random.default_rng(11)
        self.idf, self.keys = idf, keys
        self.r, self.log_c, self.b = rng.gamma(2, 1, DRAWS), np.log(rng.gamma(2, 1, DRAWS)), rng.random(DRAWS)
        self.common = self._score(np.full(DRAWS, math.log(idf.rare)), np.arange(DRAWS))[0]

    def _score(self, log_weight: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the sample minimises, as an ordered 32-bit number in the high half, and the step t."""
        r = self.r[draw]
        t = np.floor(log_weight / r + self.b[draw])
        bits = (self.log_c[draw] - r * (t - self.b[draw] + 1)).astype(np.float32).view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))
        return ordered.astype(U64) << U64(32), t.astype(np.int64)

    def signatures(self, shingles: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row of samples, 64-bit each, for each bag; bags must not be empty."""
        weight = self.idf.of(shingles) * counts
        log_weight = np.log(weight)
        odd = np.flatnonzero(weight != self.idf.rare)
        place = np.arange(len(shingles), dtype=U64)
        out = np.empty((len(bounds) - 1, len(self.keys)), U64)
        for k, key in enumerate(self.keys):
            draw = ((shingles * key) >> U64(48)).astype(np.int64)
            score = self.common[draw]
            if len(odd):
                score[odd] = self._score(log_weight[odd], draw[odd])[0]
            win = (np.minimum.reduceat(score | place, bounds[:-1]) & U64(0xFFFFFFFF)).astype(np.int64)
            step = self._score(log_weight[win], draw[win])[1]
            out[:, k] = mix64(shingles[win] ^ (step.astype(U64) * U64(0xA24BAED4963EE407)))
        return out


def _agreement(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The share of samples in which each row's sketch agrees with one."""
    return (rows == one).mean(axis=1)


def weighted_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Of two bags of ascending shingles with their weights."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    shared = np.minimum(wx[hit], wy[at[hit]]).sum()
    return float(shared / (wx.sum() + wy.sum() - shared))


def _named(raw: bytes, cuts: list[int], null: list[bool]) -> list[bytes | None]:
    return [None if z else hashlib.md5(raw[a:b], usedforsecurity=False).digest() for a, b, z in zip(cuts[:-1], cuts[1:], null, strict=True)]


def _sign(shared, words: int):
    """(node, size, bands, sketch) of the texts that have words; of equal texts of a task once. size: shingles with repeats."""
    schema = pa.schema([("node", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = None
        done: set[bytes] = set()
        for batch in batches:
            sampler = sampler or Sampler(Idf(*shared.value))
            texts = batch.column(0)
            data, offsets = utf8(texts)
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                piece = data[part[0] : part[-1]]
                part = part - part[0]
                shingles, counts, bounds = bags(piece, part, words)
                names = _named(piece.tobytes(), part.tolist(), [False] * (last - first))
                full = np.flatnonzero(np.diff(bounds) > 0)
                if not len(full):
                    continue
                signature = sampler.signatures(shingles, counts, np.append(bounds[:-1][full], bounds[-1])).reshape(len(full), BANDS, ROWS)
                band = np.zeros((len(full), BANDS), U64) + np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
                for j in range(ROWS):
                    band = mix64(band ^ signature[:, :, j])
                sketch = (signature.reshape(len(full), BANDS * ROWS) & U64(0xFF)).astype(np.uint8)
                sizes = np.add.reduceat(counts, bounds[:-1][full])
                new = []
                for row, v in enumerate(full.tolist()):
                    if names[v] not in done:
                        done.add(names[v])
                        new.append(row)
                at = pa.array(np.arange(len(new) + 1, dtype=np.int32) * BANDS)
                columns = [pa.array([names[full[r]] for r in new], pa.binary()), pa.array(sizes[new], pa.int64()), pa.ListArray.from_arrays(at, pa.array(band[new].view(np.int64).ravel())), pa.array([sketch[r].tobytes() for r in new], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        released()

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal keys, from rows in the order of the keys.

    What is held at a time is a batch and the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        same = np.ones(batch.num_rows, bool)
        for k, x in zip(keys, last, strict=True):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == x
        begins = batch.num_rows - int(same.sum())
        if begins == 0 and held and tuple(held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys) == last:
            held.append(batch)
            continue
        if held or begins:
            yield pa.Table.from_batches([*held, *([batch.slice(0, begins)] if begins else [])])
        held = [batch.slice(begins)]
    if held:
        yield pa.Table.from_batches(held)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(fresh), len(fresh))


def bucket_pairs(node: list[bytes], sketch: np.ndarray, lead: tuple[bytes, np.ndarray] | None = None) -> list[tuple[bytes, bytes]]:
    """The pairs to verify first among texts that share a band, in the order of their names.

    A small bucket: all whose sketches agree enough. In a large one, of which this may be a part, texts are paired
    with the first few leaders that they agree with, the first of the whole bucket, ``lead``, among them; so most of a group
    of near copies is joined at a cost that follows the texts. Leaders follow the names, so that the pairs of one
    group are mostly the same in each band.
    """
    if lead is not None and lead[0] not in node:
        node, sketch = [lead[0], *node], np.vstack([lead[1][None], sketch])
    n = len(node)
    out: list[tuple[bytes, bytes]] = []
    large = n > PAIRWISE or lead is not None
    free, paired = np.ones(n, bool), np.zeros(n, int)
    for k in range(n - 1 if not large else n):
        if not free[k]:
            continue
        agree = _agreement(sketch, sketch[k])
        if large:
            agree[k] = 0
            chosen = np.flatnonzero((agree >= ESTIMATE) & (paired < PAIRS))
            paired[chosen] += 1
            free &= agree < LIKELY
        else:
            chosen = np.flatnonzero(agree[k + 1 :] >= ESTIMATE) + k + 1
        out += [(min(node[j], node[k]), max(node[j], node[k])) for j in chosen.tolist()]
    return out


_PAIR = pa.schema([("node", pa.binary()), ("other", pa.binary())])


def _pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], schema=_PAIR)


def _sketches(table: pa.Table, name: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(len(table), -1)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, other): the first pairs of each group (band, part)."""
    for table in whole_groups(batches, ["band", "part"]):
        node, sketch, n = table["node"].to_pylist(), _sketches(table), table["n"].to_numpy()
        cuts = _cuts(table["band"].to_numpy(), table["part"].to_numpy())
        sizes = np.diff(cuts)
        two = cuts[:-1][(sizes == 2) & (n[cuts[:-1]] == 2)]
        two = two[(sketch[two] == sketch[two + 1]).mean(axis=1) >= ESTIMATE] if len(two) else two
        pairs = [(min(node[k], node[k + 1]), max(node[k], node[k + 1])) for k in two.tolist()]
        for a, b in zip(cuts[:-1][sizes * (n[cuts[:-1]] > 2) > 0].tolist(), cuts[1:][sizes * (n[cuts[:-1]] > 2) > 0].tolist(), strict=True):
            lead = table["lead"][a].as_py()
            pairs += bucket_pairs(node[a:b], sketch[a:b], (lead["node"], np.frombuffer(lead["sketch"], np.uint8)) if lead else None)
        pairs = list(set(pairs))
        for k in range(0, len(pairs), 1 << 15):
            yield _pairs_batch(pairs[k : k + (1 << 15)])
    released()


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell (band, a, b) the rows that have a partner: sketches agree enough, components differ, and no
    earlier band is shared, as the pair is compared there."""
    for table in whole_groups(batches, ["band", "a", "b"]):
        cuts = _cuts(*(table[k].to_numpy() for k in ("band", "a", "b")))
        sketch, lead, place = _sketches(table), table["leads"].to_numpy(), table["place"].to_numpy()
        roots = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1]
        bands = table["bands"].combine_chunks()
        bands = (bands if isinstance(bands, pa.Array) else pa.concat_arrays(bands.chunks)).flatten().to_numpy().reshape(len(table), BANDS)
        keep = np.zeros(len(table), bool)
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ours, theirs = np.flatnonzero(lead[first:last]) + first, np.flatnonzero(~lead[first:last]) + first
            own, of, before = sketch[theirs], roots[theirs], bands[theirs, : place[first]]
            for k in ours.tolist():
                fit = np.flatnonzero((of != roots[k]) & (_agreement(own, sketch[k]) >= ESTIMATE))
                fit = fit[~(before[fit] == bands[k, : place[first]]).any(axis=1)]
                if len(fit):
                    keep[k] = True
                    keep[theirs[fit]] = True
        if keep.any():
            for batch in table.select(["band", "a", "b", "node", "root", "leads"]).filter(pa.array(keep)).to_batches():
                yield batch
    released()


def _vectors(words: int):
    """(node, vector) of each text: shingles in ascending order, then how often each occurs.

    Counts take a byte each, or four where one of the text exceeds 255, and are left out where all are one.
    """
    schema = pa.schema([("node", pa.binary()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            nodes = batch.column("node")
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                shingles, counts, bounds = bags(data[part[0] : part[-1]], part - part[0], words)
                out = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    most = counts[a:b].max() if b > a else 1
                    tail = counts[a:b].astype(np.uint8 if most < 256 else "<u4").tobytes() if most > 1 else b""
                    out.append((b - a).to_bytes(4, "little") + shingles[a:b].astype("<u8").tobytes() + tail)
                yield pa.RecordBatch.from_arrays([nodes.slice(first, last - first), pa.array(out, pa.binary())], schema=schema)
        released()

    return run


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    width = (len(raw) - 4 - 8 * n) // max(n, 1)
    counts = np.frombuffer(raw, np.uint8 if width == 1 else "<u4", n, 4 + 8 * n) if width else np.ones(n, np.uint8)
    return np.frombuffer(raw, "<u8", n, 4), counts.astype(np.int64)


def _verify(shared, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = None
        memo: dict[bytes, tuple] = {}
        size = 0

        def bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            if raw not in memo:
                if size > BLOCK:
                    memo.clear()
                    size = 0
                shingles, counts = _unpack(raw)
                memo[raw] = shingles, counts * idf.of(shingles)
                size += len(shingles)
            return memo[raw]

        for batch in batches:
            idf = idf or Idf(*shared.value)
            kept = [k for k, (a, b) in enumerate(zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)) if weighted_jaccard(*bag(a), *bag(b)) >= similarity - 1e-12]
            if kept:
                yield pa.RecordBatch.from_arrays(batch.select(["node", "other"]).take(pa.array(kept)).columns, schema=_PAIR)
        memo.clear()
        released()

    return run


def block_links(vectors: list[bytes], roots: np.ndarray, lead: np.ndarray, idf: Idf, similarity: float) -> list[tuple[int, int]]:
    """Links, as few as join the components, between leading rows and the others of other components.

    What two bags share is a matrix product over columns, a shingle that occurs c times being c columns; pairs near the
    threshold or above it are computed again in double precision.
    """
    parts = [_unpack(v) for v in vectors]
    sizes = np.array([int(c.sum()) for _, c in parts])
    row = np.repeat(np.arange(len(parts)), sizes)
    shingles = np.concatenate([np.repeat(s, c) for s, c in parts])
    weight = idf.of(shingles)
    again = np.concatenate([np.arange(k) - np.repeat(np.cumsum(c) - c, c) for k, (_, c) in zip(sizes.tolist(), parts, strict=True)])
    key = np.where(again > 0, mix64(shingles + again.astype(U64) * U64(0x9E3779B97F4A7C15)), shingles)
    total = np.bincount(row, weight, len(parts))
    order = np.argsort(key, kind="stable")
    key, row, weight = key[order], row[order], weight[order].astype(np.float32)
    cuts = _cuts(key)
    ours, theirs = np.flatnonzero(lead), np.flatnonzero(~lead)
    place = np.empty(len(parts), np.int64)
    place[ours], place[theirs] = np.arange(len(ours)), np.arange(len(theirs))
    leads = lead[row]
    both = np.logical_or.reduceat(leads, cuts[:-1]) & np.logical_or.reduceat(~leads, cuts[:-1])
    shared = np.zeros((len(ours), len(theirs)), np.float32)
    chosen = np.flatnonzero(both)
    for at in range(0, len(chosen), COLUMNS):
        part = chosen[at : at + COLUMNS]
        wide = cuts[part + 1] - cuts[part]
        column = np.repeat(np.arange(len(part)), wide)
        entry = np.repeat(cuts[part], wide) + np.arange(len(column)) - np.repeat(np.cumsum(wide) - wide, wide)
        left, right = np.zeros((len(ours), len(part)), np.float32), np.zeros((len(theirs), len(part)), np.float32)
        mine = leads[entry]
        left[place[row[entry[mine]]], column[mine]] = weight[entry[mine]]
        right[place[row[entry[~mine]]], column[~mine]] = 1
        shared += left @ right.T
    parent = {r: r for r in roots.tolist()}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def bag(k: int) -> tuple[np.ndarray, np.ndarray]:
        s, c = parts[k]
        return s, c * idf.of(s)

    links: list[tuple[int, int]] = []
    for i, a in enumerate(ours.tolist()):
        similar = shared[i] / (total[a] + total[theirs] - shared[i])
        near = theirs[similar >= similarity - 1e-3]
        for b in near[np.argsort(-similar[similar >= similarity - 1e-3], kind="stable")].tolist():
            if find(int(roots[a])) != find(int(roots[b])) and weighted_jaccard(*bag(a), *bag(b)) >= similarity - 1e-12:
                parent[find(int(roots[a]))] = find(int(roots[b]))
                links.append((a, b))
    return links


def _blocks(shared, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = None
        for table in whole_groups(batches, ["band", "a", "b"]):
            idf = idf or Idf(*shared.value)
            cuts = _cuts(*(table[k].to_numpy() for k in ("band", "a", "b")))
            for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = table.slice(first, last - first)
                lead = own["leads"].to_numpy()
                if lead.all() or not lead.any():
                    continue
                node = own["node"].to_pylist()
                roots = np.unique(np.array(own["root"].to_pylist(), object), return_inverse=True)[1]
                links = block_links(own["vector"].to_pylist(), roots, lead, idf, similarity)
                if links:
                    yield _pairs_batch([(min(node[a], node[b]), max(node[a], node[b])) for a, b in links])
        released()

    return run


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for a key, where one key may hold a large share of ``rows``.

    ``counts`` (key, __rows) says how many rows a key has. Keys of over HOT rows are at most (rows / HOT), small enough
    to share; their rows are dealt to SPREAD places by a hash of ``by``, and their row of ``table`` is sent to each.
    """
    hot = F.broadcast(counts.where(F.col("__rows") > HOT).select(F.col(key).alias("__hot")))
    salt = F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int")
    left = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), salt).otherwise(0)).drop("__hot")
    places = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(places)).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def _settled(pairs: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: each component is a star around its least node."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(pairs.select(F.col("v"), F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return seen.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def components(edges: DataFrame, a: str = "node", b: str = "other") -> DataFrame:
    """(node, root) of each node of an edge; root is the least node of its component.

    Alternating large-star and small-star steps, each a grouped minimum and a join, until all components are stars.
    Each step's edges are written to the shared folder; their number never grows.
    """
    pairs = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _settled(pairs):
        # large star: neighbours above u point to the least of u and its neighbours
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__rows")).withColumn("m", F.least("u", "m")))
        large = spread_join(both.where("v > u"), least.select("u", "m"), "u", ["v"], least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        # small star: u and its neighbours below point to the least of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(below.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = written(small)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _name(text: Column) -> Column:
    """A text's node: a 128-bit hash."""
    return F.unhex(F.md5(text))


def crowded_cells(rows: DataFrame, roots: DataFrame) -> DataFrame | None:
    """The rows of large buckets that are more than one component, dealt to cells (band, a, b).

    What isn't in a bucket's largest component leads: it goes to one of the blocks a and meets, in each block b, all
    rows of the bucket. Blocks hold about BLOCK shingles, so a bucket isn't one task, however large, and the work is
    that of what is left apart times the bucket. None if every bucket is one component.
    """
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows.withColumn("cost", F.greatest("size", F.lit(128))))
    of = rows.groupBy("band", "root").agg(F.sum("cost").alias("cost"))
    of = of.groupBy("band").agg(F.max(F.struct("cost", "root")).alias("top"), F.sum("cost").alias("all"), F.count("*").alias("n_roots")).where("n_roots > 1")
    of = of.select("band", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.cost")) / BLOCK).cast("int").alias("na"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nb"))
    of = written(of)
    if of.isEmpty():
        return None
    own = rows.join(of, "band")
    of_block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["band", "place", "a", "b", "node", "root", "bands", "sketch", "leads"]
    leading = own.where("root <> top").withColumn("a", of_block("na")).withColumn("b", every("nb")).withColumn("leads", F.lit(True)).select(*keep)
    others = own.withColumn("b", of_block("nb")).withColumn("a", every("na")).withColumn("leads", F.lit(False)).select(*keep)
    return leading.unionByName(others)


def _cell_rows(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "a", "b").sortWithinPartitions("band", "a", "b")


def classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row (doc_id, node, class_id, n_texts) for each row of ``docs`` (doc_id, text, ...).

    class_id is the least doc_id of the class: all texts joined by chains of links of at least ``similarity``. Equal
    texts are one node. A text of one to four words has one shingle, all its words; texts without words are alike only
    if equal; a null text is alone, its node null and its class its own doc_id. Null doc_ids don't name a class unless
    all of it are null. Repeated rows share their class. Very long texts are read whole, all their shingles count; other
    columns play no part, whatever their names. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    idf = fit_idf(docs, words=words)
    shared = spark.sparkContext.broadcast((idf.shingles, idf.weights, idf.rare))
    signed = docs.select("text").where("text is not null").mapInArrow(_sign(shared, words), "node binary, size long, bands array<long>, sketch binary")
    signed = written(signed.dropDuplicates(["node"]))
    named = docs.select("doc_id", _name(F.col("text")).alias("node"))

    banded = signed.select("node", "size", "bands", "sketch", F.posexplode("bands").alias("place", "band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(banded.select("band", "place", "node", "sketch").join(sizes, "band").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP))))
    parted = rows.where(F.col("n") > GROUP)
    parted = parted.join(parted.groupBy("band").agg(F.min(F.struct("node", "sketch")).alias("lead")), "band")
    whole = rows.where(F.col("n") <= GROUP).withColumn("lead", F.lit(None).cast(parted.schema["lead"].dataType))
    first = whole.unionByName(parted).select("band", "part", "node", "sketch", "n", "lead").repartition("band", "part").sortWithinPartitions("band", "part", "node")
    pairs = written(first.mapInArrow(_first, "node binary, other binary").distinct())

    def vectors(nodes: DataFrame) -> DataFrame:
        texts = docs.where("text is not null").select(_name(F.col("text")).alias("node"), "text").groupBy("node").agg(F.first("text").alias("text"))
        return texts.join(nodes.hint("merge"), "node", "left_semi").mapInArrow(_vectors(words), "node binary, vector binary")

    def counted(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("__rows"))

    ends = pairs.select("node").union(pairs.select(F.col("other").alias("node"))).distinct()
    found = written(vectors(ends))
    sided = spread_join(pairs, found.withColumnRenamed("vector", "va"), "node", ["other"], counted(pairs, "node"))
    sided = spread_join(sided, found.select(F.col("node").alias("other"), F.col("vector").alias("vb")), "other", ["node"], counted(pairs, "other"))
    links = written(sided.mapInArrow(_verify(shared, similarity), "node binary, other binary"))
    roots = components(links)

    crowded = rows.where(F.col("n") > PAIRWISE).select("band", "place", "node", "sketch").join(signed.select("node", "size", "bands"), "node")
    if (cells := crowded_cells(crowded, roots)) is not None:
        wanted = written(_cell_rows(cells).mapInArrow(_wanted, "band long, a int, b int, node binary, root binary, leads boolean"))
        if not wanted.isEmpty():
            found = written(vectors(wanted.select("node").distinct()))
            full = _cell_rows(spread_join(wanted, found, "node", ["band", "a", "b"], counted(wanted, "node")))
            more = written(full.mapInArrow(_blocks(shared, similarity), "node binary, other binary"))
            if not more.isEmpty():
                roots = components(roots.select("node", F.col("root").alias("other")).union(more))
    shared.unpersist()
    per_node = written(named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("__rows")))
    rooted = per_node.select("node", "first").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    per_root = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("n_texts"), F.count("*").alias("__rows"))
    of_node = spread_join(rooted, per_root.drop("__rows"), "root", ["node"], per_root).select("node", "class_id", "n_texts")
    out = spread_join(named, of_node, "node", ["doc_id"], per_node, "left")
    return out.select("doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_texts", F.lit(1)).cast("long").alias("n_texts"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class; of rows that share it, one.

    Rows with null text have a class each and all stay.
    """
    kept = classes(docs, **options).where(F.col("node").isNotNull()).groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__doc"), F.col("k.node").alias("__node"))
    named = docs.withColumn("__md5", _name(F.col("text")))
    full = named.where("text is not null").join(kept, (F.col("__md5") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
    one = full.dropDuplicates(["__md5"]).drop("__doc", "__node")
    return one.unionByName(named.where("text is null")).drop("__md5")
