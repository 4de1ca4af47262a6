"""Language of web pages by fusing evidence of text, declared language, address suffix and host.

Text likelihoods come from hashed byte trigrams counted over all documents of known language.
What a declared language or an address suffix says is learned as well: soft counts of the text
posterior by declaration and by suffix, so evidence that contradicts the texts weighs little. The
prior of a host is its own soft counts smoothed by its domain, and that by all pages. Each
table of soft counts is a grouped aggregation; a page's own evidence is fused in log space.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.common import cut_lineage, per_batch, strings

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 13
DAMPING = 0.2  # trigrams overlap, so each counts for a fifth of independent evidence
MOST = 60.0  # the largest log-likelihood difference that text may bring
SMOOTH_HOST, SMOOTH_DOMAIN, SMOOTH_TABLE = 5.0, 20.0, 10.0

_HIDDEN = re.compile(r"(?is)<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>")
# every alternative runs to its end or that of the page, so a page is walked once
_MARKUP = re.compile(r"(?is)<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|template)\b.*?(?:</\1\s*>|\Z)|<(?=[a-z/!?])((?:html|meta)\b)?[^>]*")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,3})")
_META_NAME = re.compile(r"(?i)content-language")
_CONTENT = re.compile(r"(?i)content\s*=\s*[\"']?\s*([a-z]{2,3})")


def declared_language(page: str) -> str:
    """The language of the first html tag that names one, wherever it stands, else of the first such meta tag; "" if none."""
    meta = ""
    for tag in _MARKUP.finditer(page):
        if not tag[2]:
            continue
        if tag[2].lower() == "html":
            if found := _LANG.search(tag[0]):
                return found[1].lower()
        elif not meta and (name := _META_NAME.search(tag[0])) and (found := _CONTENT.search(tag[0], name.end())):
            meta = found[1].lower()
    return meta


def trigram_buckets(text: str) -> np.ndarray:
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", dtype=np.uint8)
    gap = raw < 33
    raw = np.where(gap, 32, raw)[~(gap & np.append(False, gap[:-1]))].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def fit_trigrams(documents: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log probabilities, BUCKETS by languages, from every whole text of a known language. A fixed number of counts reaches the driver."""
    known = documents.where(F.col("lang").isin(*languages)).select("lang", "text")

    def run(batches):
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch, "text")):
                counts[languages.index(lang)] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        at, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "bucket": bucket.astype(np.int32), "n": counts[at, bucket]})

    rows = known.mapInArrow(run, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for r in rows:
        counts[r["bucket"], r["at"]] += r["n"]
    return np.log(counts / counts.sum(axis=0))


def page_evidence(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, declared ("" if none), likelihood (log, per language) of every page's visible text."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("declared", T.StringType()), T.StructField("likelihood", T.ArrayType(T.DoubleType()))])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            declared, likelihood = [], []
            for page in strings(batch, "html"):
                declared.append(declared_language(page))
                found = weights[trigram_buckets(html.unescape(_HIDDEN.sub(" ", page)))].sum(axis=0) * DAMPING
                likelihood.append(np.maximum(found - found.max(), -MOST).tolist())
            columns = [batch.column("page_id"), batch.column("url"), pa.array(declared, pa.string()), pa.array(likelihood, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        return step

    return per_batch(pages.select("page_id", "url", "html"), schema, make)


def _normal(logs: Column) -> Column:
    """Probabilities from an array of log weights."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _log_sum(*parts: Column) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b)
    return total


def _soft_counts(pages: DataFrame, keys: list[str], n: int) -> DataFrame:
    return pages.groupBy(*keys).agg(F.array(*[F.sum(F.col("belief")[i]) for i in range(n)]).alias("held"))


def _shares(held: Column, prior: Column, strength: float) -> Column:
    whole = F.aggregate(held, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(held, prior, lambda h, p: (h + strength * p) / (whole + strength))


def identify(pages: DataFrame, documents: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """page_id, url, lang, probability, text_lang, declared, suffix, host of every page.

    A page without text, declaration or address gets what the rest says, in the end the prior of
    all pages. NULL html counts as empty, a NULL url as no address; equal beliefs go to the first
    language by name. Repeated rows get equal results (each counts in the priors); other columns
    are ignored. Without any labelled document all texts are equally likely.
    """
    n = len(languages)
    evidence = page_evidence(pages, fit_trigrams(documents, languages))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    named = evidence.withColumn("host", host)
    named = named.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    names = F.array(*[F.lit(x) for x in languages])
    rows = cut_lineage(named.withColumn("belief", _normal(F.col("likelihood"))))
    sums = rows.agg(*[F.sum(F.col("belief")[i]) for i in range(n)]).first()
    overall = np.array([x or 0.0 for x in sums]) + 1.0
    prior = F.array(*[F.lit(float(x)) for x in overall / overall.sum()])

    def reliability(column: str) -> DataFrame:
        """log P(value | language): the value's soft counts against those of all pages."""
        table = _soft_counts(rows, [column], n).withColumn("share", _shares(F.col("held"), prior, SMOOTH_TABLE))
        return cut_lineage(table.select(column, F.zip_with("share", prior, lambda s, p: F.log(s / p)).alias(f"{column}_says")))

    domains = _soft_counts(rows, ["domain"], n).select("domain", _shares(F.col("held"), prior, SMOOTH_DOMAIN).alias("domain_prior"))
    hosts = _soft_counts(rows, ["host", "domain"], n).join(cut_lineage(domains), "domain")
    hosts = cut_lineage(hosts.select("host", _shares(F.col("held"), F.col("domain_prior"), SMOOTH_HOST).alias("host_prior")))
    fused = rows.join(hosts, "host")
    for column in ("declared", "suffix"):
        fused = fused.join(reliability(column), column)
    logs = _log_sum(F.col("likelihood"), F.col("declared_says"), F.col("suffix_says"), F.transform("host_prior", lambda x: F.log(x)))
    fused = fused.withColumn("chance", _normal(logs)).withColumn("top", F.array_max("chance"))
    pick = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return fused.select(
        "page_id", "url", pick(F.col("chance")).alias("lang"), F.round("top", 9).alias("probability"), pick(F.col("belief")).alias("text_lang"), "declared", "suffix", "host"
    )
