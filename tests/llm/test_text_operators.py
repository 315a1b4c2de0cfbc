import hashlib
import itertools
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup, packing, quality, suffixdedup, textarrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_shingles_follow_their_definition():
    texts = ["", None, "a", "one two\tthree", " x  y z ", "é" * 5 + " ß\n\nb c d e f g", "w " * 900]
    data, offsets = textarrays.utf8(pa.array(texts))
    starts, ends, bounds = textarrays.words(data, offsets)
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]
    found, counts, at = textarrays.bags(data, offsets)
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        want = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        assert sorted(want.values()) == sorted(counts[at[k] : at[k + 1]].tolist())


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(textarrays, "SPAN", 50)
    data, offsets = textarrays.utf8(pa.array(["alpha beta gamma " * 20, "gamma beta alpha"]))
    starts, ends, _ = textarrays.words(data, offsets)
    hashes = textarrays.word_hashes(data, starts, ends)
    by = defaultdict(set)
    for a, b, h in zip(starts, ends, hashes, strict=True):
        by[bytes(data[a:b])].add(int(h))
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == 3


def _measured(text):
    w = WORD.findall(text or "")
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(covered)


def test_quality_measures(spark, documents, none):
    extra = spark.createDataFrame([(900, "a b c a b c x\n\n \nsame line\nsame line\n#* $$", "clash")], "doc_id long, text string, kept string")
    for docs in (documents, extra):
        for r in quality.judge(docs).collect():
            got = (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words)
            assert got == _measured(r.text)
            assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and (not r.kept or not r.base_failed)
    assert quality.judge(none).count() == 0
    assert "Python" not in quality.judge(documents)._jdf.queryExecution().executedPlan().toString()


def _pieces(docs, **options):
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), **options).collect()


def test_packing_holds_every_id_once(documents, corpus, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = _pieces(documents)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, copies in itertools.groupby(sorted(corpus, key=lambda x: (x[0] is None, x[0])), key=lambda x: x[0]):
        copies = list(copies)
        ids = [*tokenizer.encode(copies[0][1] or "", add_special_tokens=False).ids, 1]
        got = np.zeros(len(ids), int)
        for r in by_doc[doc_id]:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids)
            got[r.start : r.start + r.length] += 1
        assert (got == len(copies)).all()
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= pieces[0].capacity <= 2048
        padded += (2048 if at & (at - 1) else at) - at
    assert padded <= 2048 * 4
    assert _pieces(none) == []


def test_encoder_agrees_with_the_tokenizer_on_odd_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["don't won't. it's", "~ a~b ~~", "İstanbul ΟΔΟΣ. ςΣ", "é x y 12,345.67!!", "***&&& --- '' 's", " line\u0085x", "tab\tend \n\n", "a" * 300, "日本語 text😀."]
    tokenizer = Tokenizer.from_file(path)
    ids, bounds = packing.Encoder(path).texts(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_letters_go_to_the_model_as_the_tokenizer_would_send_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert encoder.model
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    words = [w for c in letters for w in (c, f"{c}b", f"a{c}b", f"the{c}", c * 3, f"{c}e\u0301", f"Une{c}s!", f"it's{c}")]
    texts = [*words, "the", "!", "the! the!", "the ! the!!"]
    for text in texts:
        ids, bounds = encoder.texts(pa.array([text]))
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_a_large_vocabulary_is_tokenized_once(monkeypatch):
    import public_tokenizers

    encoder, met = packing.Encoder(public_tokenizers.path("word_bpe_49k.json")), Counter()
    tokenize = packing.Encoder._tokenize
    monkeypatch.setattr(packing.Encoder, "_tokenize", lambda self, words: (met.update(words), tokenize(self, words))[1])
    words = ["".join(x) for x in itertools.product("abcdefghij", repeat=5)]
    texts = [" ".join(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
    once = [encoder.texts(pa.array([t]))[0].tolist() for t in texts]
    assert [encoder.texts(pa.array([t]))[0].tolist() for t in texts] == once
    assert len(met) == len(words) and set(met.values()) == {1}
    encoder.trim(1 << 20)
    assert encoder.held <= 1 << 20 and len(encoder.known) < 10_000
    assert [encoder.texts(pa.array([t]))[0].tolist() for t in texts] == once


def _brute_dedup(rows, length):
    top = max(x[0] for x in rows if x[0] is not None) + 1
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda x: (top if x[0] is None else x[0], x[1] or "")):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((-1 if doc_id is None else doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [4 << 20, 6000])
def test_suffix_dedup_against_brute_force(documents, corpus, none, monkeypatch, chunk):
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffixdedup, "GRAM_BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffixdedup, "SUFFIX_BUCKET_BYTES", 9_000)
    out = suffixdedup.dedup(documents.withColumn("kept", F.lit("clash"))).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)
    assert got == _brute_dedup([x[:2] for x in corpus], 100)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in out)
    assert suffixdedup.dedup(none).count() == 0


def test_suffix_blocks_and_shorter_strings(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SORTED_AT_ONCE", 500)
    rng = np.random.default_rng(0)
    rows = [(k, "".join(rng.choice(list("ab"), 300))) for k in range(30)] + [(40, "ab" * 200), (41, "x" * 500)]
    rows += [(50 + k, rows[k][1][40:200] + "é" + rows[k + 1][1][:90]) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixdedup.dedup(docs, 40).collect())
    assert got == _brute_dedup(rows, 40)


@pytest.mark.parametrize("n", [600, 12_000])
def test_a_large_bucket_is_compared_in_bounded_blocks(monkeypatch, n):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", 1 << 15, raising=False)
    rng = np.random.default_rng(1)
    gram, passage = (rng.integers(0, 256, size, np.uint8) for size in (28, 50))
    heads = np.zeros(n, suffixdedup._HEAD)
    heads["doc"], heads["n"], heads["off"] = rng.permutation(n), rng.integers(1, 41, n), 60
    texts = []
    for k in range(n):  # a passage's edge: the gram and what precedes it are the same, then texts part at some place
        text = rng.integers(0, 256, int(heads["n"][k]) + 99, np.uint8)
        text[10:60], text[60:88] = passage, gram
        if k % 3:
            text[:10], text[88:] = 7, 9
        texts.append(text)
    heads["off"][::5] = 59
    text, chunks = np.concatenate(texts), rng.integers(0, 9, n)
    first: dict[bytes, int] = {}
    for k in np.argsort(heads["doc"]).tolist():
        for j in range(int(heads["n"][k])):
            first.setdefault((int(heads["off"][k]) - j, texts[k][j : j + 100].tobytes()), (k, j))
    want = [first[int(heads["off"][k]) - j, texts[k][j : j + 100].tobytes()] != (k, j) for k in range(n) for j in range(int(heads["n"][k]))]
    tracemalloc.start()
    try:
        got = suffixdedup.repeats(heads, chunks, text)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.tolist() == want and sum(want)
    assert n < 1000 or peak < 20 * len(text)


def test_cleaned_texts_hold_whole_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 80), (2, "x" + "é" * 70)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in suffixdedup.cleaned(docs).collect()}
    assert out[2] == "x" and "�" not in out[1]


def _bag(text):
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _classes_by_force(rows, total):
    """doc_id -> class by comparing all pairs; rows: (doc_id, text) without null texts."""
    texts = list(dict.fromkeys(t for _, t in rows))
    bags = [_bag(t) for t in texts]

    def least(text):  # what names a text's family
        found, _, _ = textarrays.bags(*textarrays.utf8(pa.array([text])))
        return int(found[0])

    df, families = Counter(s for _, t in rows for s in _bag(t)), defaultdict(set)
    for t, bag in zip(texts, bags, strict=True):
        for s in bag:
            families[s].add(least(t))
    top = np.log(max(1.0, min(1 / neardup.FREQUENT, total)))
    often = max(2.0, neardup.FREQUENT * total)
    weight = lambda s: 1 + (min(np.log(total / len(families[s])), top) if df[s] >= often / 2 else top)
    weighted = [{s: n * weight(s) for s, n in b.items()} for b in bags]
    sums = [sum(w.values()) for w in weighted]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if bags[a] and bags[b] and find(a) != find(b):
            low = sum(min(w, weighted[b][s]) for s, w in weighted[a].items() if s in weighted[b])
            if low / (sums[a] + sums[b] - low) >= neardup.SIMILARITY:
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for d, t in rows:
        members[find(texts.index(t))].append(d)
    return {d: min(x for x in own if x is not None) for own in members.values() for d in own}


def test_near_duplicate_classes(documents, corpus, none, monkeypatch):
    got = {r.doc_id: r.class_id for r in neardup.classes(documents).collect()}
    rows = [(d, t) for d, t, *_ in corpus if t is not None]
    want = _classes_by_force(rows, len(corpus))
    assert {d: got[d] for d in want} == want
    assert got[300] == 300 and got[305] == 305
    assert neardup.classes(none).count() == 0
    kept = neardup.drop_copies(documents)
    ids = [-1 if r.doc_id is None else r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids) == sorted([*set(want.values()), 300, 305]) and kept.columns == documents.columns
    # parts, blocks and hot keys of any size and files cut in any way give the same classes
    monkeypatch.setattr(neardup, "GROUP", 20)
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    monkeypatch.setattr(neardup, "HOT", 3)
    again = neardup.classes(documents.withColumn("node", F.lit("clash")).repartition(9, "text")).collect()
    assert {r.doc_id: r.class_id for r in again} == got


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(1)
    shingles = np.sort(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    a, b = np.arange(300), np.arange(60, 400)
    keys = (rng.integers(0, 1 << 62, 2000).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    counts = rng.integers(1, 4, 400)
    sampler = neardup.Sampler(neardup.Idf(np.zeros(0, np.uint64), np.zeros(0)), keys)
    one, two = (sampler.signatures(shingles[x], counts[x], np.array([0, len(x)]))[0] for x in (a, b))
    both = counts[60:300].sum()
    want = both / (counts[a].sum() + counts[b].sum() - both)
    assert abs((one == two).mean() - want) < 0.04


def test_components_of_chains(spark):
    edges = [(f"{k:04d}".encode(), f"{k + 1:04d}".encode()) for k in range(60) if k != 30]
    got = {bytes(r.node): bytes(r.root) for r in neardup.components(spark.createDataFrame(edges, "node binary, other binary")).collect()}
    assert got[b"0030"] == b"0000" and got[b"0060"] == b"0031" and len(got) == 59


def _family(texts, seed=5):
    """Texts that share about two thirds of their shingles with each other, and over four fifths with their partner."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(1 << 40)}"

    def edited(words, runs, length):
        words = list(words)
        for at in rng.choice(len(words) // 20, runs, replace=False) * 20:
            words[at : at + length] = [word() for _ in range(length)]
        return words

    base, rows = [word() for _ in range(500)], []
    for k in range(texts // 2):
        own = edited(base, 4, 10)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edited(own, 3, 11)))]
    return rows


def test_members_of_a_family_below_the_threshold_meet_their_partners(spark, monkeypatch):
    rows = _family(300)
    bags = [set(_bag(t)) for _, t in rows]
    alike = lambda a, b: len(bags[a] & bags[b]) / len(bags[a] | bags[b])
    assert min(alike(2 * k, 2 * k + 1) for k in range(150)) > 0.82 and max(alike(0, k) for k in range(2, 300)) < 0.79
    want = _classes_by_force(rows, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "GROUP", 50)
    monkeypatch.setattr(neardup, "BLOCK", 20_000)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs.repartition(6)).collect()} == want


def test_block_links_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64))
    vectors, bags = [], []
    for _ in range(80):
        own = np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(1, 1 << 62, 3).astype(np.uint64)]))
        counts = rng.choice([1, 1, 1, 2, 300], len(own), p=[0.3, 0.3, 0.3, 0.09, 0.01])
        vectors.append(len(own).to_bytes(4, "little") + own.tobytes() + counts.astype("<u4" if counts.max() > 255 else np.uint8).tobytes())
        bags.append((own, counts))
    idf = neardup.Idf(base[:20], np.linspace(1, 5, 20))
    lead, roots = np.arange(80) < 30, np.arange(80)
    links = neardup.block_links(vectors, roots, lead, idf, 0.6)
    weighted = [(s, c * idf.of(s)) for s, c in bags]
    near = {(a, b) for a in range(30) for b in range(30, 80) if neardup.weighted_jaccard(*weighted[a], *weighted[b]) >= 0.6}
    group = lambda edges: {frozenset(x) for x in _joined(80, edges)}
    assert near and set(links) <= near and group(links) == group(near)


def _joined(n, edges):
    own = [{k} for k in range(n)]
    for a, b in edges:
        if own[a] is not own[b]:
            own[a] |= own[b]
            for x in own[b]:
                own[x] = own[a]
    return own


def test_groups_are_whole_whatever_the_batches():
    keys = np.sort(np.random.default_rng(0).integers(0, 9, 50))
    for size in (1, 3, 7, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size])], ["k"]) for k in range(0, 50, size)]
        seen = [t["k"].to_pylist() for t in neardup.whole_groups(iter(batches), ["k"])]
        assert sum(seen, []) == keys.tolist() and all(not set(a) & set(b) for a, b in itertools.combinations(seen, 2))


def test_every_member_of_a_component_meets_texts_of_other_tasks(spark):
    # one task holds a base and edits of it, all linked; others hold an edit of one of those, too far from the rest
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(1 << 40)}"

    def edited(words, start, runs):
        words = list(words)
        for at in range(start, start + runs * 10, 10):
            words[at : at + 5] = [word() for _ in range(5)]
        return words

    base = [word() for _ in range(500)]
    copies = [edited(base, 10 * (k % 45), 5) for k in range(60)]
    outside = [edited(copies[k], (10 * (k % 45) + 250) % 450, 5) for k in range(60)]
    rows = [(0, " ".join(base)), *((1 + k, " ".join(t)) for k, t in enumerate(copies)), *((100 + k, " ".join(t)) for k, t in enumerate(outside))]
    bags = {d: set(_bag(t)) for d, t in rows}
    alike = lambda a, b: len(bags[a] & bags[b]) / len(bags[a] | bags[b])
    assert all(alike(0, 1 + k) > 0.82 and alike(100 + k, 1 + k) > 0.82 and alike(100 + k, 0) < 0.72 for k in range(60))
    inside = spark.createDataFrame(rows[:61], "doc_id long, text string").coalesce(1)
    docs = inside.unionAll(spark.createDataFrame(spark.sparkContext.parallelize(rows[61:], 60), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in neardup.classes(docs.coalesce(8)).collect()} == _classes_by_force(rows, len(rows))


def test_vectors_hold_counts_of_every_size():
    def bag(repeats, others):
        text = " ".join(["a b c d e"] * repeats + [f"{others}{k}" for k in range(100)])
        (batch,) = neardup._vectors(5)(iter([pa.RecordBatch.from_arrays([pa.array([b"n"]), pa.array([text])], ["node", "text"])]))
        shingles, counts = neardup._unpack(batch.column("vector")[0].as_py())
        assert sorted(counts.tolist()) == sorted(_bag(text).values())
        return shingles, counts

    assert 0.95 < neardup.weighted_jaccard(*bag(1000, "x"), *bag(1000, "y")) < 0.97
    assert neardup.weighted_jaccard(*bag(255, "x"), *bag(400, "x")) < 0.7
    for repeats in (1, 2, 255, 256):
        bag(repeats, "x")
