import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, html, language, mixing, oracle, sharding

CALL = json.dumps({"tool_calls": [{"id": "c1", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "c2", "name": "calculator", "arguments": '{"b": 1, "expression": 2}'}]})
MESSAGES = [
    (1, 0, "user", "hi"), (1, 1, "assistant", CALL), (1, 3, "tool", json.dumps({"tool_call_id": "c2", "content": "4"})), (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "y"})),
    (1, 4, "assistant", "done"), (2, 0, "tool", json.dumps({"tool_call_id": "c1", "content": "lost"})), (2, 1, None, None), (None, 1, "assistant", CALL), (3, 0, "user", "{not json"),
    (3, 5, "tool", json.dumps({"tool_call_id": "z", "content": "early"})), (3, 7, "assistant", json.dumps({"tool_calls": [{"id": "z", "name": "nothing", "arguments": {}}, {"id": "w", "name": "fetch", "arguments": {}}]})), (1, 4, "assistant", "done"),
]


def test_chat_links_orders_and_validates(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    rows = chat.link(df).collect()
    assert len(rows) == len(MESSAGES)
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_depth, r.turn))
    assert [(r.turn, r.kind) for r in one] == [(0, "message"), (1, "call"), (2, "result"), (3, "result"), (4, "message"), (4, "message")]
    call = one[1]
    assert (call.n_calls, call.n_valid_calls, call.n_unanswered) == (2, 1, 0)
    assert call.errors == ["c2: expression is not of type string", "c2: unexpected b"]
    parsed = json.loads(call.message_json)
    assert list(parsed) == ["role", "tool_calls"] and list(parsed["tool_calls"][0]) == ["arguments", "id", "name"] and parsed["tool_calls"][1]["arguments"] == '{"b":1,"expression":2}'
    lost = next(r for r in rows if r.conv_id == 2 and r.turn == 0)
    assert not lost.linked and lost.errors == ["c1: no such call"] and lost.order_turn == 0
    early = next(r for r in rows if r.conv_id == 3 and r.turn == 5)
    assert early.linked and (early.order_turn, early.order_depth) == (7, 1)
    late = next(r for r in rows if r.conv_id == 3 and r.turn == 7)
    assert late.errors == ["z: unknown tool", "w: missing url"] and late.n_unanswered == 1
    assert next(r for r in rows if r.conv_id == 2 and r.turn == 1).message_json == "{}"
    assert chat.link(df.limit(0)).count() == 0
    assert "Python" not in chat.link(df)._jdf.queryExecution().executedPlan().toString()


def test_chat_identifiers_used_again_and_kept_fields(spark):
    call = lambda *ids: json.dumps({"tool_calls": [{"id": i, "name": "fetch", "arguments": {"url": "u"}, "more": [1.0, {"z": 1e0, "a": None}]} for i in ids], "meta": {"b": 1.50, "a": "1.0"}})
    answer = lambda i, **more: json.dumps({"tool_call_id": i, "content": "x", **more})
    rows = [
        (1, 0, "assistant", call("a")), (1, 1, "tool", "  \n" + answer("a", name="n1")), (1, 2, "assistant", call("a")), (1, 3, "tool", answer("a")), (1, 4, "tool", answer("a")),
        (1, 6, "assistant", call("a", "b")), (1, 7, "tool", answer("b")), (1, 7, "tool", answer("b")), (2, 0, "assistant", call("n")), (None, 1, "tool", answer("a")),
        (3, 0, "user", "word " * 200_000), (3, 1, "assistant", json.dumps({"tool_calls": [{"id": "q", "name": "search", "arguments": '{"query": "x", "limit": 100000000000000000000000}'}]})),
        (3, 2, "assistant", '{"tool_calls": [{"id": "t", "name": "search", "arguments": "{\\"query\\": 1, \\"query\\": \\"x\\"}"}]}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("waiting", "calls", "id", "owner", "at", "conv", "m", "v", "first", "json"):
        df = df.withColumn(c, F.lit(1))
    got = chat.link(df).collect()
    assert len(got) == len(rows) and set(df.columns) < set(got[0].asDict())
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].order_turn for t in (1, 3, 4)] == [0, 2, 2] and [by[1, t].errors for t in (1, 3, 4)] == [[], [], ["a: answered before"]]
    assert (by[1, 0].n_unanswered, by[1, 2].n_unanswered, by[1, 6].n_unanswered, by[2, 0].n_unanswered) == (0, 0, 1, 1)
    assert (by[1, 7].order_turn, by[1, 7].order_depth, by[1, 7].errors) == (6, 2, []) and not by[None, 1].linked
    assert by[1, 2].message_json == '{"meta":{"a":"1.0","b":1.5},"role":"assistant","tool_calls":[{"arguments":"{\\"url\\":\\"u\\"}","id":"a","more":[1,{"a":null,"z":1}],"name":"fetch"}]}'
    assert json.loads(by[1, 1].message_json) == {"tool_call_id": "a", "content": "x", "name": "n1", "role": "tool"}
    assert by[3, 1].n_valid_calls == 1 and by[3, 2].errors == ["t: arguments are not an object"] and len(by[3, 0].message_json) > 10**6


def test_chat_query_against_its_sql(spark, tmp_path):
    import duckdb

    from tessera.llm import queries

    rows = [(c, t, r, x) for c in range(4) for t, r, x in [(0, "system", "s"), (1, "user", "ab"), (2, "assistant", "é\n\"q\""), (5, "user", "abcde"), (3, "assistant", "early"), (6, "assistant", "late"), (8, "user", None), (9, "assistant", "no")]]
    rows += [(1, 6, "assistant", "late"), (7, 3, "user", "odd"), (7, 4, "assistant", None), (8, 2, None, None), (9, 0, "user", "{}"), (9, 6, "user", "word " * 9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    ours = queries.op1_chat_formatting(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = con.execute(oracle.oracle_sql()["op1_chat_formatting"]).df()[list(ours.columns)]
    key = lambda df: sorted(map(str, df.itertuples(index=False)))
    assert key(ours) == key(theirs) and ours["linked"].sum() > 8 and (ours["n_valid_calls"] < ours["n_calls"]).any()


def test_table_filling_is_even_and_stable():
    shards = [f"s{k}" for k in range(7)]
    table = sharding.fill(shards, 1009)
    assert table == oracle._filled(shards, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.fill(shards, 1000)


def test_sharding(spark, documents, none):
    out = sharding.shard(documents.withColumn("shard", F.lit("clash")), "doc_id", ["a", "b", "c"], 101)
    assert out.count() == documents.count() and out.select("doc_id", "shard").distinct().groupBy("doc_id").count().where("count > 1").count() == 0
    assert out.where("shard_name is null").count() == 0 and sharding.shard(none, "doc_id", ["a"], 101).count() == 0


def _targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(documents, corpus, none, monkeypatch):
    rows = mixing.mix_documents(documents).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size and r.size == len((dict((x[0], x[1]) for x in corpus)[r.doc_id] or "").split())
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = _targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2
    again = mixing.mix_documents(documents.repartition(7, "text"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert mixing.mix_documents(none).count() == 0
    monkeypatch.setattr(mixing, "BLOCK", 40)  # several blocks and levels
    small = defaultdict(int)
    for r in mixing.mix_documents(documents).collect():
        small[r.source] += r.taken
    for s in sizes:
        assert abs(small[s] - want[s]) <= 0.02 * want[s] + 2


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    out = mixing.flight(size, p, rng, 0)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)


def test_taken_documents_repeat(documents):
    want = defaultdict(int)
    for r in mixing.mix_documents(documents).collect():
        want[r.doc_id] += r.times
    out = mixing.take(documents)
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == documents.columns and got == {k: n for k, n in want.items() if n}


def test_language_on_held_out_documents(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    found = language.identify(test, language.fit(train), declared=F.lit(None).cast("string")).collect()
    assert np.mean([r.text_language == r.lang for r in found]) > 0.95
    assert np.mean([r.language == r.lang for r in found]) > 0.95 and all(0 <= r.posterior <= 1.0001 for r in found)
    assert language.identify(none).count() == 0


def test_language_fuses_its_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    rows = [(1, None, "en", "h"), (2, "", "en", "h"), (3, "zz9", "de", "h"), (3, "zz9", "de", "h"), (4, "the thing of the ing and that", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("language", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert not got[1].accepted and got[1].language is None and not got[2].accepted
    assert got[3].language == "de" and got[4].language == "en"
    pages = spark.createDataFrame([("https://x.example.de/a", "<html lang='fr-FR'>"), ("http://x.org/es/b", "<html>"), (None, None)], "url string, html string")
    seen = pages.select(language.address_language(F.col("url")).alias("a"), language.declared_in(F.col("html")).alias("d")).collect()
    assert [(r.a, r.d) for r in seen] == [("de", "fr"), ("es", None), (None, None)]


def test_foreign_texts_are_rejected_and_clean_ones_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    clean = [r.accepted for r in language.identify(docs.where("doc_id % 2 = 1 and n_chars > 200"), model).collect()]
    assert np.mean(clean) > 0.98
    foreign = ["Съешь же ещё этих мягких французских булок да выпей чаю. " * 4, "いろはにほへとちりぬるをわかよたれそつねならむ。" * 5, "0x3f 99182 77-12 ### 4451 9981 " * 8, "Příliš žluťoučký kůň úpěl ďábelské ódy. " * 5, "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura. " * 4]
    df = spark.createDataFrame([(k, t, "en", "src0") for k, t in enumerate(foreign)], "doc_id long, text string, lang string, source string")
    assert not any(r.accepted for r in language.identify(df, model).collect())


def test_posteriors_and_smoothed_priors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    model = language.Model(("aa", "bb", "cc"), np.log(rng.dirichlet(np.ones(language.BUCKETS), 3).T + 1e-9).astype(np.float32), np.tile([-99.0, 1.0], (3, 1)))
    words = ["abc", "bcd x", "zzzz", "q w e r", "hello there", "", None, "ab"]
    rows = [(k, words[int(rng.integers(8))], ["aa", "bb", "xx", None][int(rng.integers(4))], [None, "http://a.one.de/x", "http://b.one.de/y", "http://c.two.org/fr/z"][int(rng.integers(4))], 1.0) for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, text string, markup string, url string, __prior double")
    suffixes = {"de": "aa", "fr": "bb"}
    host = language.host_of(F.col("url"))
    address = F.when(F.col("url").contains("/fr/"), "bb").when(F.col("url").contains(".de/"), "aa")
    got = {r.page_id: r for r in language.identify(df, model, declared=F.col("markup"), address=address, host=host).collect()}
    assert len(got) == 80 and suffixes and got[0]["__prior"] == 1.0

    def says(value, trust):
        return np.log([trust if value == x else (1 - trust) / 2 for x in model.languages]) if value in model.languages else np.zeros(3)

    def likelihood(text):
        data = (text or "").encode()
        codes = [((((data[i] << 16) | (data[i + 1] << 8) | data[i + 2]) * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for i in range(len(data) - 2)]
        return None if not codes else model.table[codes].astype(float).mean(axis=0) * min(len(codes), language.EFFECTIVE)

    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    local, hosts, shares = {}, {}, defaultdict(list)
    for k, text, markup, url, _ in rows:
        name = "" if url is None else url.split("/")[2]
        hosts[k] = (name, ".".join(name.split(".")[-2:]) if "." in name else "")
        ll = likelihood(text)
        spoken = None if url is None else "bb" if "/fr/" in url else "aa" if ".de/" in url else None
        local[k] = (0 if ll is None else ll) + says(markup, language.DECLARED_TRUST) + says(spoken, language.ADDRESS_TRUST)
        if ll is not None:
            shares[hosts[k]].append(soft(local[k]))
    sums = {h: (len(x), np.sum(x, axis=0)) for h, x in shares.items()}
    n_all, sum_all = sum(n for n, _ in sums.values()), sum(x for _, x in sums.values())
    root = (sum_all + 1) / (n_all + 3)
    pull = language.HOST_STRENGTH
    for k, text, *_ in rows:
        own = [(n, x) for h, (n, x) in sums.items() if h[1] == hosts[k][1]]
        parent = (sum(x for _, x in own) + pull * root) / (sum(n for n, _ in own) + pull)
        n, x = sums[hosts[k]]
        post = soft(local[k] + np.log((x + pull * parent) / (n + pull)))
        if likelihood(text) is None:
            assert got[k].language is None and got[k].posterior == 0 and not got[k].accepted
        else:
            assert got[k].posterior == pytest.approx(post.max(), abs=1e-6) and got[k].language == model.languages[int(post.argmax())]


def _brute(rows, queries, k):
    out = {}
    for q in queries:
        x = np.array(dict(rows)[q], float)
        near = sorted((float(np.sqrt(((np.array(v, float) - x) ** 2).sum())), i) for i, v in rows if i != q and v is not None and len(v) == len(x))
        out[q] = near[:k]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(900)] + [(1000 + k, [1.0] * 16) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    queries = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    got = defaultdict(list)
    for r in ann.nearest(df, queries, shard=400).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = _brute(rows, [k for k, _ in rows if k % 100 == 0], 10)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    assert got[1000] == [(0.0, k) for k in range(1001, 1011)]
    for q, near in got.items():
        assert near == sorted(near) and len(near) == 10


def test_neighbours_leave_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    queries = df.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, queries).collect()) == [(0, 1, 1), (0, 2, 1)]
    assert ann.nearest(df.limit(0), queries.limit(0)).count() == 0


def _page(body, side="<div class='sidebar'><p>Popular things that others read today on this site</p></div>"):
    return f"<!doctype html><html><head><title>T</title><script>var x='<p>no</p>';</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></ul></nav>{side}<div class='story-{len(body) % 7}'>{body}</div><div id='comments'><p>{'I do not agree at all. ' * 40}</p></div><div class='cookie-notice'>We use cookies</div><footer>&copy; all</footer></body></html>"


def test_html_extraction(spark):
    bodies = [f"<h2>Title {k}</h2><p>First &amp; <b>bold</b>\n text   {k} " + "word " * 30 + "<p>Second<br>line &eacute;</p><ul><li>one<li>two</ul>" for k in range(8)]
    rows = [(k, f"http://h.example/{k}", _page(b)) for k, b in enumerate(bodies)] + [(90, None, None), (91, "http://h.example/e", ""), (92, "http://other.example/", "plain text < 5 only"), (93, "x", "<p>unclosed <b>tag <div><p>a</div")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == f"Title {k}\n\nFirst & bold text {k} " + " ".join(["word"] * 30) + "\n\nSecond line é\n\none\n\ntwo"
    assert got[90] == "" and got[91] == "" and got[92].startswith("plain text") and "unclosed" in got[93] + "unclosed"


def test_hosts_agree_on_a_path(spark):
    # on one page a stray block is longer than the article; the host's other pages settle which it is
    def page(article, stray):
        return f"<body><div class='c1'><p>{article}</p></div><div class='misc'><p>{stray}</p></div></body>"

    rows = [(k, "http://h/x", page("article text " * 20, "short")) for k in range(9)] + [(9, "http://h/y", page("the real article here " * 5, "stray words " * 30))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == " ".join(["the real article here"] * 5)


def test_pipeline_on_a_small_corpus(spark, corpus, tmp_path):
    import corpus_pipeline
    from tests.llm.conftest import DOCS

    spark.createDataFrame(corpus, DOCS).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    pieces = out.collect()
    assert pieces and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert {r.doc_id for r in pieces} <= {x[0] for x in corpus}


def test_deep_and_broken_pages():
    deep = html.Page("<div>" * 20_000 + "<p>" + "text " * 50)
    assert deep.extract([])[0].startswith("text text")
    for broken in ("<", "<p", "<p a='", "<!-- x", "<script>", "</p></div>", "<a href=x>y", "\x00<p>z", "<p/>q<br/>r"):
        assert isinstance(html.Page(broken).extract([])[0], str)


def test_language_sample_holds_every_label_and_counts_copies_once(spark):
    from tessera.llm import language

    rows = [(f"one two three {k}", "en") for k in range(600)] + [("the same text again", "en")] * 600 + [(f"uno dos tres {k}", "es") for k in range(3)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample=40)
    assert model.languages == ("en", "es")
    once = language.fit(spark.createDataFrame([*dict.fromkeys(rows)], "text string, lang string"), sample=40)
    assert (model.table == once.table).all()


def test_hostile_pages_are_read_in_linear_time():
    import time

    n = 1 << 17
    bodies = ["<a" * n, '<a "' * n, "<a \"'>" * n, "<a " + "b" * 5 * n + ">", "<b>" + "<div>" * n + "</b>" * n, "<ul>" + "<span>" * n + "<li>x" * n, "<script>" + "</script" * n, "<!" * n, "&" * 5 * n, "<p>" + "<i>" * n + "<hr>t" * n]
    for body in bodies:
        began = time.process_time()
        html.Page(f"<body><p>first words</p>{body}").extract([])
        assert time.process_time() - began < 12, body[:20]


def test_siblings_and_lists_and_formulas_of_an_article_stay():
    text = lambda body: html.Page(f"<body>{body}</body>").extract([])[0]
    assert text(f"<div class=content><p>{'one ' * 50}</p></div><div class=content2><p>{'two ' * 75}</p></div>").startswith("one")
    long, short = "long words " * 60, "short words " * 8
    assert text(f"<article><h1>T</h1><div class=sec><p>{long}</p></div><div class=sec><p>{short}</p></div></article>") == f"T\n\n{long.strip()}\n\n{short.strip()}"
    assert "See this" in text(f"<article><p>{long}</p><ul><li><a href=x>See this</a></ul><p>Sum <math><mi>x</mi></math></p></article>") and text(f"<article><p>{long} <math><mi>xy</mi></math></p></article>").endswith("xy")


def test_pages_that_repeat_and_none(spark):
    rows = [(1, "http://h/a", "<p>some words here</p>", "clash")] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert [r.text for r in html.extract(df).collect()] == ["some words here"] * 3 and html.extract(df.limit(0)).count() == 0
