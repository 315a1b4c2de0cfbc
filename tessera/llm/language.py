"""Language identification by fusing the evidence of text, declaration, address and host."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import cut, small_batches
from tessera.llm.textarrays import released, slices, utf8

BUCKETS = 1 << 16
SAMPLE = 8000  # distinct labelled texts, at most, from which the text model is fitted
LEAST_LABELS = 3
#: A text's likelihood is tempered to so many independent trigrams at most, so that other evidence can still speak.
EFFECTIVE = 60.0
DECLARED_TRUST = 0.9
ADDRESS_TRUST = 0.8
HOST_STRENGTH = 20.0  # documents that a parent's prior counts as in its child's
LEAST_POSTERIOR = 0.5
#: How far below that bound (see ``least_likely``) the mean of few trigrams may fall by chance, in deviations.
DEVIATIONS = 4.0
BROADCAST_HOSTS = 100_000
#: Address suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


@dataclass(frozen=True)
class Model:
    """Log probabilities of hashed byte trigrams: one column for each language.

    ``usual`` has for each language the median of its texts' mean log probability of a trigram, and the deviation from
    trigram to trigram.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    usual: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    @property
    def empty(self) -> bool:
        return not self.languages


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams that lie within one value, and n + 1 bounds; Latin letters count as small."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    capital = (data >= 0x41) & (data <= 0x5A)
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    x = data.astype(np.uint32) + capital * np.uint32(0x20)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.ones(len(code), bool)
    for back in (1, 2):  # those that begin in the last two bytes of a value reach into the next
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(code))]] = False
    kept = np.flatnonzero(inside)
    return code[kept].astype(np.int64), np.searchsorted(kept, offsets)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """The text model from at most ``sample`` distinct labelled texts, equally many of each language, the least by a hash.

    The bound on the sample is a parameter; what reaches the driver is one count vector for each language and
    each of four tasks, and three sums for each. The odd half of the sample, by the hash, is scored with counts of the
    even half to learn what is usual for a text that the model hasn't seen; then all counts make the model. Labels are counted over all rows: languages with fewer than three documents are left out; no
    labels, an empty model. Each language has three texts at least, so very many languages exceed the sample.
    """
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    known = sorted(r["label"] for r in labelled.groupBy("label").count().where(F.col("count") >= LEAST_LABELS).collect())
    if not known:
        return Model((), np.empty((BUCKETS, 0), np.float32))
    each = max(LEAST_LABELS, sample // len(known))
    least = labelled.select("label", "h").distinct().withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("place") <= each)
    last = least.groupBy("label").agg(F.max("h").alias("last"))
    chosen = labelled.join(F.broadcast(last), "label").where("h <= last").groupBy("label", "h").agg(F.first("text").alias("text")).select("label", "text", F.pmod("h", F.lit(2)).cast("int").alias("half"))
    chosen = cut(chosen.repartition(4))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            halves = batch.column("half").to_numpy()
            labels = np.array(batch.column("label").to_pylist(), object)
            for lang, half in {*zip(labels.tolist(), halves.tolist(), strict=True)}:
                own = batch.column("text").filter(pa.array((labels == lang) & (halves == half)))
                data, offsets = utf8(own)
                for first, last in slices(offsets):
                    part = offsets[first : last + 1]
                    grams, _ = _trigrams(data[part[0] : part[-1]], part - part[0])
                    sums[lang, half] = sums.get((lang, half), 0) + np.bincount(grams, minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["label", "half", "counts"]
            )

    total: dict[tuple[str, int], np.ndarray] = {}
    for row in chosen.mapInArrow(count, "label string, half int, counts binary").toLocalIterator():
        key = row["label"], row["half"]
        total[key] = total.get(key, 0) + np.frombuffer(row["counts"], "<i8")
    nothing = np.zeros(BUCKETS, np.int64)
    counts = {k: (total.get((k, 0), nothing), total.get((k, 1), nothing)) for k in known}
    languages = tuple(k for k in known if (counts[k][0] + counts[k][1]).any())
    even, table = (np.stack([_log_share(f(counts[k])) for k in languages], axis=1) if languages else np.empty((BUCKETS, 0), np.float32) for f in (lambda c: c[0], sum))
    return Model(languages, table, _usual(chosen, languages, even))


def _log_share(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.5
    return np.log(smooth / smooth.sum()).astype(np.float32)


def _usual(chosen: DataFrame, languages: tuple[str, ...], even: np.ndarray) -> np.ndarray:
    """Of each language the median of its odd texts' mean trigram, and the deviation of trigrams within a text."""
    if not languages:
        return np.zeros((0, 2))
    shared = chosen.sparkSession.sparkContext.broadcast(even)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for lang, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                data, offsets = utf8(pa.array([text.as_py()]))
                grams, _ = _trigrams(data, offsets)
                if lang in languages and len(grams):
                    found = shared.value[grams, languages.index(lang)].astype(np.float64)
                    out.append((lang, len(grams), found.mean(), found.var()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["label", "n", "mean", "var"])

    texts = chosen.where("half = 1").select("label", "text").mapInArrow(score, "label string, n long, mean double, var double").collect()
    shared.destroy()
    rows = []
    for lang in languages:
        own = [(r["n"], r["mean"], r["var"]) for r in texts if r["label"] == lang]
        if not own:
            rows.append((-math.inf, 0.0))
            continue
        n, mean, var = (np.array(x, float) for x in zip(*own, strict=True))
        rows.append((float(np.median(mean)), math.sqrt(float(var @ n / n.sum()))))
    return np.array(rows)


def least_likely(usual: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least mean log probability of n trigrams at which a text may be in a language, a column for each.

    Half way from what is usual to what trigrams drawn evenly would have: a text that is less likely is closer to noise.
    """
    half = (usual[:, 0] + math.log(1 / BUCKETS)) / 2
    return half - DEVIATIONS * usual[:, 1] / np.sqrt(np.maximum(n, 1))[:, None]


def likelihoods(df: DataFrame, model: Model, text: str = "text", out: str = "loglik") -> DataFrame:
    """``df`` with the tempered log likelihood of each language for each whole text; null for a text of under three bytes.

    One more number follows: by how much the text is likelier than the least that is usual, in the language that explains it best.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.table, model.usual))  # BUCKETS x languages

    @F.arrow_udf("array<double>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, usual = shared.value
        n_languages = table.shape[1]
        for column in texts:
            data, offsets = utf8(column)
            parts, spoken = [], []
            for first, last in slices(offsets, 1 << 19):
                part = offsets[first : last + 1]
                grams, bounds = _trigrams(data[part[0] : part[-1]], part - part[0])
                n = np.diff(bounds)
                full = np.flatnonzero(n > 0)
                total = np.zeros((len(n), n_languages))
                for j in range(n_languages if len(full) else 0):
                    total[full, j] = np.add.reduceat(table[:, j][grams], bounds[:-1][full], dtype=np.float64)
                mean = total / np.maximum(n, 1)[:, None]
                least = least_likely(usual, n) if len(usual) else np.full(mean.shape, -np.inf)
                parts.append(np.column_stack([mean * np.minimum(n, EFFECTIVE)[:, None], (mean - least).max(axis=1)]))
                spoken.append(n > 0)
            values = np.concatenate(parts).ravel() if parts else np.zeros(0)
            none = ~np.concatenate(spoken) if spoken else np.zeros(0, bool)
            at = pa.array(np.arange(len(none) + 1, dtype=np.int32) * (n_languages + 1))
            del data, offsets, column
            released()
            yield pa.ListArray.from_arrays(at, pa.array(values), mask=pa.array(none))

    return df.withColumn(out, score(F.col(text)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def address_language(url: Column) -> Column:
    """The language that an address speaks for: a path segment of two letters at its start, or else its suffix."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})(?:/|$)", 1)
    suffix = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.when(path != "", path).otherwise(known[suffix])


def declared_in(html: Column) -> Column:
    """The language that markup declares, without its region; null if it declares none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def _evidence(column: Column, model: Model, trust: float) -> Column:
    """Log probability of a stated language under each true one; a statement outside the model says nothing."""
    n = len(model.languages)
    hit, miss = math.log(trust), math.log((1 - trust) / max(n - 1, 1))
    known = F.coalesce(column.isin(list(model.languages)), F.lit(False))
    return F.array(*[F.when(known, F.when(column == lang, F.lit(hit)).otherwise(F.lit(miss))).otherwise(F.lit(0.0)) for lang in model.languages])


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


RESULT = ["language", "posterior", "accepted", "text_language"]


def identify(
    docs: DataFrame, model: Model | None = None, text: str = "text", declared: Column | None = None, address: Column | None = None, host: Column | None = None, parent: Column | None = None
) -> DataFrame:
    """``docs`` with language, posterior, accepted and text_language (what the text alone says).

    log posterior = tempered text likelihood + declared language + address + host prior. A host's prior is the mean
    of what its documents say without it, smoothed toward its parent's, which is smoothed toward that of all; the
    means are grouped aggregates, so a host with a third of all rows is summed where its rows lie. Over ``documents`` the
    column ``lang`` is the declaration and ``source`` the host; there is no address. Texts are scored twice instead
    of being shuffled; only (host, sums) move, and hosts are broadcast up to a checked number.

    A document is accepted if its text has a trigram, the best language a posterior of one half, and the text is not
    far less likely than is usual for any fitted language, as one in another language or in none is. Null text:
    not accepted, its language is null. Null declaration, address or host say nothing. Of languages with equal posteriors
    the first by name is taken. Very long texts are read whole. Without a model's languages nothing is accepted.
    Repeated rows get equal results; columns named like a result give way, other names don't matter; no rows, no rows.
    """
    declared = F.col("lang") if declared is None else declared
    host = F.col("source") if host is None else host
    small_batches(docs.sparkSession)
    docs = docs.drop(*RESULT)
    model = fit(docs, text) if model is None else model
    if model.empty:
        return docs.select("*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("text_language"))
    n = len(model.languages)
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1) if parent is None else parent
    # from here on all columns of the caller are within one, so that no name of theirs meets one of ours
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    given = docs.select(whole, F.col(f"`{text}`").alias("__text"), declared.alias("__declared"), (F.lit(None).cast("string") if address is None else address).alias("__address"), host.alias("__h"), parent.alias("__p"))
    scored = likelihoods(given, model, "__text", "__all").withColumn("__ll", F.slice("__all", 1, n))
    local = _plus(F.coalesce("__ll", F.array(*[F.lit(0.0)] * n)), _evidence(F.col("__declared"), model, DECLARED_TRUST))
    if address is not None:
        local = _plus(local, _evidence(F.col("__address"), model, ADDRESS_TRUST))
    scored = scored.select("__row", "__ll", F.get("__all", F.lit(n)).alias("__usual"), local.alias("__local"), F.coalesce("__h", F.lit("")).alias("__host"), F.coalesce("__p", F.lit("")).alias("__parent"))
    share = scored.where("__ll is not null").select("__host", "__parent", _softmax(F.col("__local")).alias("__share"))
    sums = [F.sum(F.col("__share")[j]).alias(f"__s{j}") for j in range(n)]
    by_host = cut(share.groupBy("__host", "__parent").agg(F.count("*").alias("__n"), *sums))

    def smoothed(df: DataFrame, count: str, own: str, prior: list[Column], name: str) -> DataFrame:
        each = [(F.col(f"{own}{j}") + HOST_STRENGTH * prior[j]) / (F.col(count) + HOST_STRENGTH) for j in range(n)]
        return df.withColumn(name, F.array(*each))

    everything = by_host.agg(F.sum("__n").alias("n"), *[F.sum(f"__s{j}").alias(f"s{j}") for j in range(n)]).first()
    root = [F.lit(((everything[f"s{j}"] or 0.0) + 1.0) / ((everything["n"] or 0) + n)) for j in range(n)]
    parents = by_host.groupBy("__parent").agg(F.sum("__n").alias("__pn"), *[F.sum(f"__s{j}").alias(f"__p{j}") for j in range(n)])
    parents = smoothed(parents, "__pn", "__p", root, "__pp").select("__parent", "__pp")
    hosts = by_host.join(parents, "__parent")
    hosts = cut(smoothed(hosts, "__n", "__s", [F.col("__pp")[j] for j in range(n)], "__prior").select("__host", "__parent", "__prior"))
    few = hosts.count() <= BROADCAST_HOSTS
    joined = scored.join(F.broadcast(hosts) if few else hosts, ["__host", "__parent"], "left")
    prior = F.transform(F.coalesce("__prior", F.array(*root)), lambda x: F.log(x))
    final = joined.withColumn("__post", _softmax(_plus(F.col("__local"), prior)))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    spoken = F.col("__ll").isNotNull()
    fits = (F.array_max("__post") >= LEAST_POSTERIOR) & (F.col("__usual") >= 0)
    return final.select(
        "__row.*", F.when(spoken, best(F.col("__post"))).alias("language"), F.when(spoken, F.array_max("__post")).otherwise(0.0).alias("posterior"),
        F.coalesce(spoken & fits, F.lit(False)).alias("accepted"), F.when(spoken, best(F.col("__ll"))).alias("text_language"),
    )
