"""Language identification by Bayesian evidence fusion.

A document's posterior over the languages is the product of four pieces of
evidence: the likelihood of its text under letter trigrams, the language that
its mark-up or record declares, its address suffix, and a prior of its host.
The languages are those declared in the table, counted over all rows.  The
trigram model is fitted on a bounded sample of each language's rows; suffix
likelihoods and host priors are counts over all rows, by grouped aggregation.
A host's prior is smoothed towards its parent's (its registered domain, say),
and that one towards the whole table's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeloom.llm.bytekit import buffer_of
from pixeloom.plans.shared import bound_batches

#: Classes of bytes: 0 for what is no letter, 1-26 for a-z and A-Z, 27-63 for bytes of other letters.
CLASSES = 64
CLASS = np.zeros(256, np.int32)
CLASS[97:123] = CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = 27 + np.arange(128) % 37
#: Bytes of text that are worked on at a time, whatever texts they belong to.
WINDOW = 1 << 17
#: Rows of a language that the text model is fitted on, about; rows of the whole table a language needs to be known at all.
SAMPLE_ROWS, LEAST_ROWS = 4000, 5
#: Trigrams of a text that count in full: neighbours depend on each other, so long texts must not overrule all else.
FULL_WEIGHT = 60
#: Rows that a parent's counts weigh as in a host's prior, and the table's as in a parent's.
SMOOTHING = 20.0
#: How far a declared language is trusted.
TRUST = 0.9
#: A host or suffix table with more rows than this is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000


def trigrams(data: np.ndarray, bounds: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a batch's trigrams that hold a letter and have their middle in data[low:high], and each one's text.

    A text has a gap before and behind it.
    """
    high = len(data) if high is None else high
    own = CLASS[data[low:high]]
    left, right = np.zeros_like(own), np.zeros_like(own)
    left[1:], right[:-1] = own[:-1], own[1:]
    if low > 0:
        left[:1] = CLASS[data[low - 1]]
    if high < len(data):
        right[-1:] = CLASS[data[high]]
    left[bounds[(bounds >= low) & (bounds < high)] - low] = 0
    right[bounds[(bounds > low) & (bounds <= high)] - low - 1] = 0
    codes = (left * CLASSES + own) * CLASSES + right
    good = np.flatnonzero(codes)
    return codes[good], np.searchsorted(bounds, good + low, "right") - 1


def fit_text_model(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigrams' log probabilities, from (id, text, declared) rows.

    A language is known that ``LEAST_ROWS`` of all rows declare (where none has so many, those with the most).  Its
    sample is its rows whose hashed id falls in the share of the hash range that ``sample_rows`` is of its rows; all
    of them where there are fewer.  Whole texts count.
    """
    labels = rows.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n"))
    # one row per language
    known = labels.where(F.col("n") >= LEAST_ROWS).collect() or labels.where(F.col("n") == (labels.agg(F.max("n")).first()[0] or 0)).collect()
    if not known:
        return [], np.zeros((0, CLASSES**3), np.float32)
    languages = sorted(r.declared for r in known)
    share = F.create_map(*[F.lit(x) for r in known for x in (r.declared, min(1.0, sample_rows / r.n))])[F.col("declared")]
    picked = rows.where((F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}  # 1 MB for each language that the task meets
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            data, bounds = buffer_of(batch.column(0))
            for low in range(0, len(data), WINDOW):
                codes, text = trigrams(data, bounds, low, min(len(data), low + WINDOW))
                said = names[text] if len(text) else np.zeros(0, object)
                for name in set(names[slice(text[0], text[-1] + 1)]) if len(text) else ():
                    seen, n = np.unique(codes[said == name], return_counts=True)
                    total.setdefault(name, np.zeros(CLASSES**3, np.int32))[seen] += n.astype(np.int32)
        for name, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(n[seen].astype(np.int64))], ["declared", "code", "n"])

    # at most one row per language and trigram, whatever the input
    counts = picked.select("text", "declared").mapInArrow(count, "declared string, code long, n long").groupBy("declared", "code").agg(F.sum("n").alias("n")).toPandas()
    model = np.zeros((len(languages), CLASSES**3), np.float32)
    for k, name in enumerate(languages):
        own = counts[counts.declared == name]
        freq = np.full(CLASSES**3, 0.05)
        freq[own.code.to_numpy()] += own.n.to_numpy()
        model[k] = np.log(freq / freq.sum())
    return languages, model


def _logs(values: list[Column]) -> Column:
    return F.array(*[F.log(v) for v in values])


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``table`` on a nullable key, broadcast only where a count shows that the table is small."""
    table = F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
    return rows.join(table, key, "left")


def identify(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", parent_col: str | None = None, suffix_col: str | None = None, sample_rows: int = SAMPLE_ROWS, least_confidence: float = 0.5) -> DataFrame:
    """The columns ``keep`` of every input row, and ``_language``: struct(language, confidence, kept).

    A document is kept when its best language has at least ``least_confidence``.  A text without letters (null,
    empty, digits) has no text evidence, so ``language`` is null, and it isn't kept.  Missing or unknown declared
    languages, hosts and suffixes say nothing.  Equal posteriors go to the language first by name.  Repeated rows
    each get their row; without any declared language nothing is known and nothing is kept; an empty table gives
    an empty result; columns that aren't named are ignored or, in ``keep``, passed on whatever they hold.
    """
    bound_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    col = lambda c: none if c is None else F.col(f"`{c}`").cast("string")
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").alias("lid__id"), *([] if text_col in keep else [col(text_col).alias("lid__text")]), col(declared_col).alias("lid__declared"), col(host_col).alias("lid__host"), col(parent_col).alias("lid__parent"), col(suffix_col).alias("lid__suffix"))
    text_name = text_col if text_col in keep else "lid__text"
    languages, model = fit_text_model(base.select(F.col("lid__id").alias("id"), F.col(f"`{text_name}`").cast("string").alias("text"), F.col("lid__declared").alias("declared")), sample_rows)
    verdict = "struct<language:string,confidence:double,kept:boolean>"
    if not languages:
        return base.select(*keep, F.lit(None).cast(verdict).alias("_language")).withColumn("_language", F.struct(none.alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffer_of(batch.column(batch.schema.get_field_index(text_name)))
            sums, n = np.zeros((len(batch), len(languages))), np.zeros(len(batch), np.int64)
            for low in range(0, len(data), WINDOW):
                codes, text = trigrams(data, bounds, low, min(len(data), low + WINDOW))
                if len(text):
                    first, last = int(text[0]), int(text[-1]) + 1
                    n[first:last] += np.bincount(text - first)
                    for k in range(len(languages)):
                        sums[first:last, k] += np.bincount(text - first, shared.value[k][codes])
            scale = np.minimum(n, FULL_WEIGHT) / np.maximum(n, 1)
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, len(languages), dtype=np.int32)), pa.array((sums * scale[:, None]).ravel()))
            kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("lid__text", "lid__id") or f.name in keep]
            names = [f.name for f in batch.schema if f.name not in ("lid__text", "lid__id") or f.name in keep]
            yield pa.RecordBatch.from_arrays([*kept, each, pa.array(n)], [*names, "lid__logs", "lid__letters"])

    from pyspark.sql import types as T

    schema = T.StructType([f for f in base.schema if f.name not in ("lid__text", "lid__id") or f.name in keep])
    schema = schema.add("lid__logs", T.ArrayType(T.DoubleType())).add("lid__letters", T.LongType())
    rows = base.mapInArrow(likelihoods, schema)
    # counts over all rows, by grouped aggregation
    by = base.where(F.col("lid__declared").isin(languages)).groupBy("lid__host", "lid__parent", "lid__suffix").agg(*[F.sum((F.col("lid__declared") == x).cast("long")).alias(f"n{k}") for k, x in enumerate(languages)])
    names = [f"n{k}" for k in range(len(languages))]
    totals = by.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    everything = sum(totals)
    world = [(totals[k] + 1.0) / (everything + len(languages)) for k in range(len(languages))]
    score = F.col("lid__logs")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    uniform = F.array(*[F.lit(math.log(w)) for w in world])
    if host_col is not None:
        hosts = by.where("lid__host is not null").groupBy("lid__host").agg(F.min("lid__parent").alias("lid__up"), *[F.sum(n).alias(n) for n in names])
        parents = hosts.where("lid__up is not null").groupBy("lid__up").agg(*[F.sum(n).alias(f"p{n}") for n in names])
        hosts = hosts.join(parents, "lid__up", "left").na.fill(0, [f"p{n}" for n in names])
        all_here, all_up = sum(map(F.col, names)), sum(F.col(f"p{n}") for n in names)
        up = [(F.col(f"p{n}") + F.lit(SMOOTHING * w)) / (all_up + SMOOTHING) for n, w in zip(names, world, strict=True)]
        prior = _logs([(F.col(n) + SMOOTHING * u) / (all_here + SMOOTHING) for n, u in zip(names, up, strict=True)])
        rows = _joined(rows, hosts.select("lid__host", prior.alias("lid__prior")), "lid__host")
        score = add(score, F.coalesce("lid__prior", uniform))
    else:
        score = add(score, uniform)
    if suffix_col is not None:
        seen = by.where("lid__suffix is not null").groupBy("lid__suffix").agg(*[F.sum(n).alias(n) for n in names])
        likely = _logs([(F.col(n) + F.lit(w)) / F.lit(totals[k] + 1.0) for k, (n, w) in enumerate(zip(names, world, strict=True))])
        rows = _joined(rows, seen.select("lid__suffix", likely.alias("lid__address")), "lid__suffix")
        score = add(score, F.coalesce("lid__address", F.array(*[F.lit(0.0)] * len(languages))))
    rest = (1 - TRUST) / max(1, len(languages) - 1)
    said = F.when(F.col("lid__declared").isin(languages), F.array(*[F.when(F.col("lid__declared") == x, math.log(TRUST)).otherwise(math.log(rest)) for x in languages])).otherwise(F.array(*[F.lit(0.0)] * len(languages)))
    rows = rows.withColumn("lid__score", add(score, said))
    top = F.array_max("lid__score")
    share = 1 / F.aggregate(F.transform("lid__score", lambda s: F.exp(s - top)), F.lit(0.0), lambda a, x: a + x)
    name = F.element_at(F.array(*map(F.lit, languages)), F.array_position("lid__score", top).cast("int"))
    read = F.col("lid__letters") > 0
    found = F.struct(F.when(read, name).alias("language"), F.when(read, share).otherwise(0.0).alias("confidence"), (read & (share >= least_confidence)).alias("kept"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], found.alias("_language"))


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` with what its address and mark-up say: host, parent, suffix, declared, text (in ``evidence``)."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    host = F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1))
    parts = F.split(host, r"\.")
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "(?s)<[^>]*>", " ")
    blank = lambda c: F.when(c != "", c)
    return pages.withColumn("evidence", F.struct(blank(host).alias("host"), blank(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), ".")).alias("parent"), blank(F.element_at(parts, -1)).alias("suffix"), blank(F.lower(F.regexp_extract(html, r'(?is)<html[^>]*\slang\s*=\s*["\']?([a-z]+)', 1))).alias("declared"), text.alias("text")))
