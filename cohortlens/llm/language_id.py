"""Language identification by Bayesian evidence fusion.

Four sources are combined as log-probabilities per language:

* the text: hashed byte trigrams of its letters under a multinomial model,
  fitted on all labels of the table and a bounded sample of each one's documents;
* the declared markup language: P(declared | language);
* the address suffix: P(suffix | language);
* the host: a prior smoothed hierarchically, host -> domain -> all hosts.

The last three are estimated from the table itself by grouped aggregation of
the text posteriors; a row's own share is taken out of its host's counts.  An
extra language ``und`` (all trigrams alike) takes texts of no known language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import ship, stored

#: Documents of each label the text model is fitted on, hash buckets of trigrams, added count of a trigram.
SAMPLE_DOCS, BUCKETS, ALPHA = 5_000, 1 << 15, 0.5
#: Trigrams that count as one observation (they overlap), most observations a text counts for.
OVERLAP, MOST_EVIDENCE = 3.0, 200.0
#: Weight of the wider level in a host's and a domain's prior, added count in the declared and suffix tables.
HOST_WEIGHT, ADDED = 10.0, 1.0
#: Hosts or suffixes broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Different labels up to which a text model is fitted; more are refused.
MOST_LANGUAGES = 200
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigram_buckets(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the byte trigrams of each text's letters (runs of other
    characters count as one blank), and the number of trigrams by text."""
    raw = [b" " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    letter = _LETTER[data]
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    keep = letter | first | np.concatenate(([True], letter[:-1]))  # one blank after each run
    x, owner = np.where(letter, data, 32)[keep].astype(np.uint32), owner[keep]
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:] if len(x) > 2 else np.zeros(0, np.uint32)
    inside = owner[:-2] == owner[2:] if len(x) > 2 else np.zeros(0, bool)
    mixed = code[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - int(buckets - 1).bit_length())).astype(np.int64), np.bincount(owner[:-2][inside], minlength=len(raw))


def _runs(batch: pa.RecordBatch, name: str, most: int = 500_000) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of a batch, some at a time, so that the arrays over their bytes stay small."""
    col = batch.column(name)
    at, run, size = 0, [], 0
    for i in range(len(col)):
        t = col[i].as_py()
        if run and size + len(t or "") > most:
            yield at, run
            at, run, size = i, [], 0
        run.append(t)
        size += len(t or "") + 2
    if run:
        yield at, run


@dataclass
class TextModel:
    """Log-probability of each trigram bucket by language; the last is ``und``."""

    languages: list[str]
    log_p: np.ndarray


def sampled(docs: DataFrame, text: str, label: str, doc_id: str, sample_docs: int) -> DataFrame:
    """``label, text`` of all documents of the labels that have up to
    ``sample_docs``, and of about so many of each other label: those whose hash
    (of the id, or of the text where there is no id) is under the label's share.
    A column of more than ``MOST_LANGUAGES`` different labels is refused."""
    drawn = F.xxhash64(doc_id if doc_id in docs.columns else text)
    has = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    labelled = has.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"), drawn.alias("drawn"))
    shares = stored(labelled.groupBy("label").agg((F.lit(float(sample_docs)) / F.count(F.lit(1))).alias("share")))
    if shares.count() > MOST_LANGUAGES:
        raise ValueError(f"{label} has {shares.count()} different labels, more than {MOST_LANGUAGES}: not a language column")
    at = F.shiftrightunsigned("drawn", 11) / float(1 << 53)
    return labelled.join(F.broadcast(shares), "label").where(at < F.col("share")).select("label", "text")


def fit_text_model(
    docs: DataFrame, text: str = "text", label: str = "lang", sample_docs: int = SAMPLE_DOCS, buckets: int = BUCKETS, doc_id: str = "doc_id"
) -> TextModel:
    """Trigram counts by label over about ``sample_docs`` documents of each label
    of the table, at every size of it."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            for at, run in _runs(batch, "text"):
                got, n = trigram_buckets(run, buckets)
                ends = np.cumsum(n)
                for i in range(len(run)):
                    mine = seen.setdefault(labels[at + i], np.zeros(buckets, np.int64))
                    mine += np.bincount(got[ends[i] - n[i] : ends[i]], minlength=buckets)
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"label": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at), "n": pa.array(c[at])})

    counts = sampled(docs, text, label, doc_id, sample_docs).mapInArrow(count, "label string, bucket bigint, n bigint")
    rows = counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most MOST_LANGUAGES x buckets
    labels = rows.column("label").combine_chunks().dictionary_encode()
    found = labels.dictionary.to_pylist()
    languages = sorted(found)
    table = np.full((len(languages) + 1, buckets), ALPHA)
    place = np.array([languages.index(x) for x in found], np.int64)
    bucket, n = (rows.column(c).to_numpy() for c in ("bucket", "n"))
    table[place[labels.indices.to_numpy()], bucket] += n  # a row a label and bucket
    table[-1] = 1.0
    return TextModel([*languages, UNKNOWN], np.log(table / table.sum(1, keepdims=True)).T.copy())


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` (id, text, declared, suffix, host, domain) with the text
    replaced by its log-likelihoods ``ll`` and posterior ``p``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value.log_p
        for batch in batches:
            for at, run in _runs(batch, "text"):
                got, n = trigram_buckets(run, len(log_p))
                total = np.concatenate((np.zeros((1, log_p.shape[1])), np.cumsum(log_p[got], axis=0)))
                ends = np.cumsum(n)
                ll = total[ends] - total[ends - n]
                seen = n / OVERLAP
                ll *= (np.minimum(seen, MOST_EVIDENCE) / np.maximum(n, 1))[:, None]
                part = batch.slice(at, len(run)).drop_columns(["text"])
                for name, v in (("ll", ll), ("p", _softmax(ll))):
                    part = part.append_column(name, pa.array(list(v), pa.list_(pa.float64())))
                yield part.append_column("n_trigrams", pa.array(n.astype(np.int64)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(score, f"{kinds}, ll array<double>, p array<double>, n_trigrams bigint")


def _sums(by: DataFrame, key: str, n: int, out: str, p: str = "p") -> DataFrame:
    """Summed posteriors by key: ``key, out`` (an array)."""
    sums = [F.sum(F.get(p, F.lit(i))).alias(f"_{i}") for i in range(n)]
    return by.where(F.col(key).isNotNull()).groupBy(key).agg(*sums).select(key, F.array(*[F.col(f"_{i}") for i in range(n)]).alias(out))


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _with(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    table = stored(table)
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, key, "left")


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """One row per row of ``rows`` (``id, text, declared, suffix, host, domain``,
    all strings but the id): ``id, language, posterior, text_language,
    declared, accepted``.

    ``accepted`` is false for ``und`` and for posteriors below one half.  Texts
    that are null, empty or without letters give no evidence and are ``und``.
    Null or unknown declarations, suffixes and hosts are left out of the sum.
    """
    ship(rows.sparkSession)
    langs = model.languages
    n, known = len(langs), F.array(*[F.lit(x) for x in langs[:-1]])
    said = F.lower(F.split(F.trim("declared"), "[-_]")[0])
    rows = rows.withColumn("declared", F.when(F.array_contains(known, said), said))
    scored = stored(text_evidence(rows, model))
    spoken = scored.where("n_trigrams > 0")
    total = spoken.agg(*[F.sum(F.get("p", F.lit(i))).alias(f"_{i}") for i in range(n)]).first()
    total = np.array([total[i] or 0.0 for i in range(n)]) + ADDED
    overall = _array(total / total.sum())

    by_domain = _sums(spoken, "domain", n, "domain_n")
    by_host = _sums(spoken, "host", n, "host_n")
    by_suffix = _sums(spoken, "suffix", n, "suffix_n")
    by_declared = _sums(spoken, "declared", n, "declared_n")
    df = scored
    for table, key in ((by_domain, "domain"), (by_host, "host"), (by_suffix, "suffix"), (by_declared, "declared")):
        df = _with(df, table, key)

    own = F.when(F.col("n_trigrams") > 0, F.col("p")).otherwise(_array([0.0] * n))
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    others = lambda a: F.zip_with(a, own, lambda x, y: F.greatest(x - y, F.lit(0.0)))

    def smoothed(counts: Column, wider: Column) -> Column:
        rest = others(counts)
        return F.zip_with(rest, wider, lambda x, w: x + F.lit(HOST_WEIGHT) * w)

    def shares(a: Column) -> Column:
        return F.transform(F.array(a), lambda v: F.transform(v, lambda x: x / size(v)))[0]

    df = df.withColumn("domain_p", F.when(F.col("domain_n").isNull(), overall).otherwise(shares(smoothed(F.col("domain_n"), overall))))
    df = df.withColumn("prior", F.when(F.col("host_n").isNull(), F.col("domain_p")).otherwise(shares(smoothed(F.col("host_n"), F.col("domain_p")))))
    log = lambda a: F.transform(a, lambda x: F.log(F.greatest(x, F.lit(1e-12))))
    totals = _array(total)

    def likelihood(counts: Column, kinds: int) -> Column:
        """log P(this value | language) from the counts of the value and of all."""
        return F.zip_with(others(counts), totals, lambda x, t: F.log((x + F.lit(ADDED)) / (t + F.lit(ADDED * kinds))))

    zero = _array([0.0] * n)
    score = _plus(F.col("ll"), log(F.col("prior")))
    score = _plus(score, F.when(F.col("declared_n").isNull(), zero).otherwise(likelihood(F.col("declared_n"), n)))
    score = _plus(score, F.when(F.col("suffix_n").isNull(), zero).otherwise(likelihood(F.col("suffix_n"), n)))
    df = df.withColumn("score", score).withColumn("top", F.array_max("score"))
    posterior = 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.element_at(names, F.array_position("score", F.col("top")).cast("int"))
    by_text = F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int"))
    silent = F.col("n_trigrams") == 0
    out = df.select(
        "id",
        F.when(silent, UNKNOWN).otherwise(best).alias("language"),
        F.when(silent, F.lit(1.0)).otherwise(posterior).alias("posterior"),
        F.when(silent, UNKNOWN).otherwise(by_text).alias("text_language"),
        "declared",
    )
    return out.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= 0.5))


def page_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Evidence of web pages: visible text, ``lang`` of the html tag, and the
    host of the address with its domain (last two labels) and suffix."""
    page = F.col(html).cast("string")
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    declared = F.regexp_extract(page, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    host = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), bare.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    last, two = F.regexp_extract("host", r"[^.]+$", 0), F.regexp_extract("host", r"([^.]+\.)?[^.]+$", 0)
    return rows.select("id", "text", "declared", last.alias("suffix"), "host", two.alias("domain"))


def document_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source") -> DataFrame:
    """Evidence of plain documents: their declared language, and their source as
    the host; they have no address."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col(doc_id).cast("bigint").alias("id"),
        F.col(text).cast("string").alias("text"),
        F.col(declared).cast("string").alias("declared"),
        none.alias("suffix"),
        F.col(host).cast("string").alias("host"),
        none.alias("domain"),
    )
