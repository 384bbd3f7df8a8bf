"""Language identification by Bayesian fusion of text, markup, address and host evidence.

Text likelihoods come from byte trigrams (A-Z lower-cased) hashed to GRAMS classes, with a model
fitted on a bounded sample of labelled documents (TRAIN_ROWS of them, spread by a hash of the id);
an even distribution over classes stands for anything that is no known language. A declared
markup language and a language named by the address's country suffix or path each multiply the
odds by their reliability. Hosts have priors: sums of text posteriors by grouped aggregation,
smoothed towards their domain, which is smoothed towards all rows; a row's own part is left out.
Evidence that is missing counts for nothing. A row is kept if its best language is a known one
with a posterior of MIN_POSTERIOR or more.

Defined cases: null and empty texts, and those of one or two characters, have no text evidence and
are rejected; a null host uses the prior of all rows; repeated rows are judged alike; ties go to the language first in order; an empty
table gives no rows; without labelled rows every row is rejected; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Workspace, joined, prepare, salted, text_slices

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "other"
#: Labelled rows that the text model is fitted on, at most.
TRAIN_ROWS = 2000
GRAMS = 1 << 16
#: Trigrams overlap, so each counts for a part of independent evidence.
TEXT_WEIGHT = 0.3
#: Reliability of a declared language and of an address.
DECLARED, ADDRESS = 0.9, 0.8
#: Rows' worth of the parent's prior in a domain's and a host's.
SMOOTH_DOMAIN, SMOOTH_HOST = 50.0, 20.0
OTHER_PRIOR = 0.02
MIN_POSTERIOR = 0.5
HOT_PART = 0.001
#: Bytes of text that a worker scores at a time.
SLICE_BYTES = 1 << 20
#: Labels below a country suffix that are no domain of one owner.
SHARED_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Country suffixes that name one of the languages.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


_LOWER = np.frombuffer(bytes(range(256)).translate(LOWER), "u1")


def grams(data: bytes | np.ndarray) -> np.ndarray:
    """Class of each byte trigram of lower-cased UTF-8 text."""
    b = _LOWER[np.frombuffer(data, "u1")]
    if len(b) < 3:
        return np.zeros(0, "u2")
    g = b[:-2].astype("u4")
    for more in (b[1:-1], b[2:]):
        g <<= np.uint32(8)
        g |= more
    g *= np.uint32(2654435761)
    g >>= np.uint32(16)
    return g.astype("u2")


@dataclass
class TextModel:
    """Log-likelihood of each trigram class for each language and, last, for OTHER."""

    table: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TextModel:
        counts = np.full((len(LANGUAGES), GRAMS), 0.05)
        for lang, text in rows:
            if lang in LANGUAGES:
                counts[LANGUAGES.index(lang)] += np.bincount(grams((text or "").encode()), minlength=GRAMS)
        p = np.log(counts / counts.sum(1, keepdims=True))
        return cls(np.vstack([p, np.full((1, GRAMS), -np.log(GRAMS))]).astype("f4"))

    def score(self, texts: pa.Array) -> np.ndarray:
        """Weighted log-likelihoods, rows by languages, of a text column."""
        raw, at = joined(texts)
        out = np.zeros((len(texts), len(self.table)))
        sizes = np.maximum(np.diff(at) - 2, 0)
        has = np.flatnonzero(sizes)
        if len(has):
            # Trigrams of all texts in a row, without those that span two texts.
            whole = np.ones(len(raw) - 2, bool)
            for back in (1, 2):
                cut = at[1:-1] - back
                whole[cut[(cut >= 0) & (cut < len(whole))]] = False
            flat = grams(raw)[whole]
            starts = np.cumsum(sizes[has]) - sizes[has]
            for k, row in enumerate(self.table):
                out[has, k] = np.add.reduceat(row[flat], starts, dtype="f8") * TEXT_WEIGHT
        return out


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> TextModel:
    """Fit on a bounded sample of (lang, text), spread over all rows by a hash."""
    known = labelled.where(F.col("lang").isin(*LANGUAGES))
    chosen = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id", F.lit("train")), "lang").limit(rows)
    few = F.broadcast(chosen.select("doc_id").distinct())  # TRAIN_ROWS at most
    return TextModel.fit([(r[0], r[1]) for r in known.join(few, "doc_id").select("lang", "text").limit(2 * rows).collect()])


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents have no markup or address; their source is their host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), none.alias("declared"), none.alias("address"), F.col("source").cast("string").alias("host"), none.alias("domain"), F.col("text").cast("string").alias("text"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Visible text, declared language, address language, host and domain of web pages."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    suffix = F.lit(None).cast("string")
    for ending, lang in SUFFIXES.items():
        suffix = F.when(host.endswith(f".{ending}"), lang).otherwise(suffix)
    declared = F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    labels = F.split(host, r"\.")
    shared = (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SHARED_LABELS)
    domain = F.when(shared, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return pages.select(F.col("page_id").cast("long").alias("id"), F.nullif(declared, F.lit("")).alias("declared"), F.when(path.isin(*LANGUAGES), path).otherwise(suffix).alias("address"), host.alias("host"), domain.alias("domain"), text.alias("text"))


def _softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


NAMES = (*LANGUAGES, OTHER)
EVEN = np.array([*[(1 - OTHER_PRIOR) / len(LANGUAGES)] * len(LANGUAGES), OTHER_PRIOR])


def _columns(prefix: str) -> list[str]:
    return [f"{prefix}_{n}" for n in NAMES]


def _matrix(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _columns(prefix)], axis=1)


def _reported(values: list[str | None], trust: float) -> np.ndarray:
    """Log-likelihoods of a reported language, nothing where none of the known ones is reported."""
    miss = np.log((1 - trust) / (len(NAMES) - 1))
    out = np.zeros((len(values), len(NAMES)))
    for i, v in enumerate(values):
        if v in LANGUAGES:
            out[i] = miss
            out[i, LANGUAGES.index(v)] = np.log(trust)
    return out


def identify(evidence: DataFrame, model: TextModel, space: Workspace | None = None) -> DataFrame:
    """id, hash (of the text), lang, posterior, kept for every row."""
    spark = evidence.sparkSession
    prepare(spark)
    space = space or Workspace(spark, "language")
    passed = ["id", "hash", "has_text", "declared", "address", "host_key", "domain_key"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Text log-likelihoods (t) and the posterior from them under an even prior (o)."""
        for batch in batches:
            for i, j in text_slices(batch, SLICE_BYTES):
                part = batch.slice(i, j - i)
                t = model.score(part.column(part.num_columns - 1))
                o = _softmax(t + np.log(EVEN)) * np.array(part.column(2).to_pylist())[:, None]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, np.ascontiguousarray(np.hstack([t, o]).T))], [*passed, *_columns("t"), *_columns("o")])

    none = F.lit("")
    rows = evidence.select(
        "id", F.xxhash64("text").alias("hash"), (F.length(F.trim(F.coalesce("text", none))) > 2).alias("has_text"), "declared", "address",
        F.concat(F.coalesce("domain", none), F.lit("|"), F.coalesce("host", none)).alias("host_key"), F.coalesce("domain", none).alias("domain_key"), "text",
    )
    numbers = ", ".join(f"{c} double" for c in [*_columns("t"), *_columns("o")])
    scored = space.stage(rows.mapInArrow(score, f"id long, hash long, has_text boolean, declared string, address string, host_key string, domain_key string, {numbers}"), "scored")
    # Hosts, domains and all rows: sums of the rows' own posteriors.
    sums = [F.sum(o).alias(h) for o, h in zip(_columns("o"), _columns("h"), strict=True)]
    hosts = space.stage(scored.groupBy("host_key", "domain_key").agg(F.count(F.lit(1)).alias("n"), *sums), "hosts")
    domains = hosts.groupBy("domain_key").agg(F.count(F.lit(1)).alias("hosts"), *[F.sum(h).alias(d) for h, d in zip(_columns("h"), _columns("d"), strict=True)])
    totals = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum(h), F.lit(0.0)) for h in _columns("h")]).first()
    whole = np.array(totals[1:])
    top = (whole + EVEN * SMOOTH_DOMAIN) / (whole.sum() + SMOOTH_DOMAIN)
    hot = hosts.where(F.col("n") >= F.lit(max(1000, int(totals[0] * HOT_PART)))).select("host_key")
    # A domain of very many hosts (all hosts without a domain are of one) goes to its hosts by broadcast.
    wide = domains.where(F.col("hosts") >= F.lit(max(1000, int(totals[0] * HOT_PART)))).select("domain_key")
    placed = salted(spark, hosts, domains.drop("hosts"), "domain_key", wide)
    rows = salted(spark, scored.drop("domain_key"), placed.drop("domain_key", "n"), "host_key", hot)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, o, h, d = (_matrix(batch, x) for x in "tohd")
            domain = _smoothed(np.maximum(d - o, 0), np.tile(top, (len(o), 1)), SMOOTH_DOMAIN)
            host = _smoothed(np.maximum(h - o, 0), domain, SMOOTH_HOST)
            logs = t + np.log(host) + _reported(batch.column("declared").to_pylist(), DECLARED) + _reported(batch.column("address").to_pylist(), ADDRESS)
            p = _softmax(logs)
            best = p.argmax(axis=1)
            posterior = p[np.arange(len(p)), best]
            kept = np.array(batch.column("has_text").to_pylist(), bool) & (best < len(LANGUAGES)) & (posterior >= MIN_POSTERIOR)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array([NAMES[b] for b in best]), pa.array(posterior), pa.array(kept)], ["id", "hash", "lang", "posterior", "kept"])

    return rows.mapInArrow(fuse, "id long, hash long, lang string, posterior double, kept boolean")


def _smoothed(counts: np.ndarray, parent: np.ndarray, strength: float) -> np.ndarray:
    return (counts + strength * parent) / (counts.sum(axis=1, keepdims=True) + strength)
