"""Language of web pages by Bayesian fusion of evidence.

* *Text.* Naive Bayes over hashed byte trigrams of the visible text; trained on at most ``FIT_ROWS`` documents with a
  language (those with the smallest hash of their id). Trigrams overlap, so their evidence is divided by three.
* *Markup.* The declared language of the page (``lang`` of its root element, wherever in the page that begins) as a noisy statement:
  P(declared | language) is estimated from all pages by one grouped sum of the text's posteriors, and smoothed.
* *Address.* A prior for each host, smoothed hierarchically: the host's share of languages leans on that of its domain (the
  last two labels), which leans on that of its suffix (the last label), which leans on that of all pages. The
  shares are grouped sums of posteriors over all pages; a page's own share is left out of its host's.

posterior ~ P(text | language) P(declared | language) P(language | host).

Sums are combined before any shuffle, so a host with a third of all pages is one row of the host table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom import staging
from metaloom.llm.text import buffers, lowered, slices, tidy
from metaloom.llm.url_filter import host_of

FIT_ROWS = 8000
BUCKETS = 1 << 15
#: weight of the level above, in pages
LEAN = 5.0
#: weight of a declaration's overall frequency against what was counted for a language
DECLARED_LEAN = 10.0
OVERLAP = 3.0

_letters = np.full(256, 32, np.uint8)
_letters[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_letters[0x80:] = np.arange(0x80, 0x100)
_attribute = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?)""")
_language = re.compile(r"[\"']?\s*([A-Za-z]{2})")
_tag = re.compile(r"<[/!?]?\s*([A-Za-z][A-Za-z0-9]*)")
_ends = {name: re.compile(rf"</\s*{name}\b", re.I) for name in ("script", "style", "noscript", "template")}


def _lang_of(page: str, at: int) -> tuple[str | None, int]:
    """The language that the tag with attributes from ``at`` on declares, and where reading ended."""
    while attribute := _attribute.match(page, at):
        at = attribute.end()
        if attribute[1]:
            break
        if attribute[3] and attribute[2].lower() in ("lang", "xml:lang"):
            found = _language.match(attribute[3])
            if found:
                return found[1].lower(), at
    return None, at


def read_page(page: str) -> tuple[str, str | None]:
    """(text, declared language); one pass over the page.

    The text is that outside of tags, comments, scripts and styles, entities resolved. The language is that of the first
    root tag that has one; those in comments, scripts and other text that isn't shown don't count.
    """
    parts, at = [], 0
    declared, read = None, 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        parts.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)  # <!--> is a whole comment
            at = end + 3 if end >= 0 else len(page)
            continue
        tag = _tag.match(page, lt)
        if not tag:  # a lone sign
            parts.append("<")
            at = lt + 1
            continue
        if declared is None and lt >= read and tag[1].lower() == "html" and tag.end() == lt + 5 and page[lt + 5 : lt + 6] in ("", ">", "/", " ", "\t", "\n", "\f", "\r"):
            declared, read = _lang_of(page, tag.end())
        gt = page.find(">", tag.end())
        if gt < 0:
            break
        at = gt + 1
        hidden = _ends.get(tag[1].lower()) if page[lt + 1] not in "/!?" else None
        if hidden:
            end = hidden.search(page, at)
            at = end.start() if end else len(page)
        else:
            parts.append(" ")
    return html.unescape("".join(parts)), declared


def visible_text(page: str) -> str:
    return read_page(page)[0]


def declared_language(page: str) -> str | None:
    return read_page(page)[1]


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all byte trigrams of letters and single spaces."""
    base = int(offsets[0])
    part = _letters[data[base : int(offsets[-1])]].astype(np.uint32)
    if len(part) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
    good = (row[:-2] == row[2:]) & (part[1:-1] != 32) | (row[:-2] == row[2:]) & (part[:-2] != 32) & (part[2:] != 32)
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - 15)
    return row[:-2][good], bucket[good].astype(np.int64)


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)). Documents without a language or text don't count."""
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    some = known.select("doc_id").orderBy(F.xxhash64(F.lit("lang"), F.col("doc_id")), "doc_id").limit(rows)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(some), "doc_id")  # ``rows`` ids at most

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            langs = np.array(frame.column(0).to_pylist(), object)
            data, offsets = buffers(lowered(frame.column(1)))
            for i, j in slices(offsets):
                r, b = _trigrams(data, offsets[i : j + 1])
                for lang in set(langs[i:j]):
                    total[lang] = total.get(lang, 0) + np.bincount(b[(langs[i:j] == lang)[r]], minlength=BUCKETS)
        for lang, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.astype(np.float64).tobytes()], pa.binary())], ["lang", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    got = sample.select("lang", "text").mapInArrow(tidy(batches), "lang string, counts binary").groupBy("lang").applyInArrow(summed, "lang string, counts binary").collect()
    got = sorted(got, key=lambda r: r["lang"])  # a row for each language
    counts = np.stack([np.frombuffer(r["counts"], np.float64) for r in got]) + 0.5 if got else np.zeros((0, BUCKETS))
    return [r["lang"] for r in got], np.log(counts / counts.sum(1, keepdims=True)) if got else counts


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, text (log likelihoods / overlap, the largest 0) of every row."""
    kind = dict(pages.select("page_id").dtypes)["page_id"]
    sent = pages.sparkSession.sparkContext.broadcast(table)  # languages x BUCKETS numbers

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, declared = zip(*(read_page(x or "") for x in frame.column(2).to_pylist())) if frame.num_rows else ((), ())
            data, offsets = buffers(lowered(pa.array(texts, pa.large_string())))
            score = np.zeros((len(texts), len(languages)))
            for i, j in slices(offsets):
                r, b = _trigrams(data, offsets[i : j + 1])
                for k in range(len(languages)):
                    score[i:j, k] = np.bincount(r, sent.value[k][b], j - i)
            score = (score - score.max(1, keepdims=True)) / OVERLAP
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), frame.column(1), pa.array(declared, pa.string()), pa.array(score.tolist(), pa.list_(pa.float64()))], ["page_id", "host", "declared", "text"]
            )

    named = pages.select("page_id", F.regexp_replace(host_of(F.col("url")), r"(^[^@]*@)|(:[0-9]*$)", "").alias("host"), "html")
    out = named.mapInArrow(tidy(batches), f"page_id {kind}, host string, declared string, text array<double>")
    return out.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host, prior (of ``lang``) of every row.

    A page without text, declaration or address is judged by what is left of them; with none of the three by the share of
    languages among all pages. Ties go to the first language in alphabetical order. Repeated rows are judged alike. Without
    any document that has a language there is nothing to choose from, and lang and probability are null.
    """
    spark = pages.sparkSession
    languages, table = fit(docs)
    kind = dict(pages.select("page_id").dtypes)["page_id"]
    schema = f"page_id {kind}, lang string, probability double, text_lang string, declared string, host string, prior double"
    if not languages:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), host_of(F.col("url")).alias("host"), F.lit(None).cast("double").alias("prior"))
    n = len(languages)
    own = staging.stage(evidence(pages, languages, table), staging.new_stage(spark, "language-evidence"))
    weights = own.withColumn("e", F.transform("text", lambda x: F.exp(x))).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    weights = weights.withColumn("p", F.transform("e", lambda x: x / F.col("z")))

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        sums = rows.groupBy(*keys).agg(*(F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)))
        return sums.select(*keys, F.array(*(f"s{k}" for k in range(n))).alias("p"))

    def total(column: str):
        return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)

    def leaning(rows: DataFrame, above: str, name: str) -> DataFrame:
        size = total("p")
        return rows.withColumn(name, F.zip_with("p", above, lambda a, b: (a + F.lit(LEAN) * b) / (size + F.lit(LEAN))))

    hosts = staging.stage(summed(weights, "host", "domain", "suffix"), staging.new_stage(spark, "language-hosts"))
    every = hosts.agg(*(F.sum(F.col("p")[k]) for k in range(n))).first()
    sums = np.array([x or 0.0 for x in every]) + 0.5
    overall = F.array(*(F.lit(float(x)) for x in sums / sums.sum()))
    suffixes = leaning(summed(hosts, "suffix").withColumn("above", overall), "above", "of_suffix").select("suffix", "of_suffix")
    domains = leaning(summed(hosts, "domain", "suffix").join(suffixes, "suffix"), "of_suffix", "of_domain").select("domain", "of_domain")
    priors = hosts.join(domains, "domain").select("host", F.col("p").alias("of_host"), "of_domain")

    said = summed(weights.withColumn("declared", F.coalesce("declared", F.lit(""))), "declared")
    share = total("p") / F.lit(float(sums.sum()))
    per_language = F.array(*(F.lit(float(x)) for x in sums))
    said = said.select("declared", F.zip_with("p", per_language, lambda a, b: F.log((a + F.lit(DECLARED_LEAN) * share) / (b + F.lit(DECLARED_LEAN)))).alias("said"))

    def judge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(languages, object)
        for frame in frames:
            if frame.num_rows == 0:
                continue
            text, of_host, of_domain, say = (np.array(frame.column(c).to_pylist(), np.float64).reshape(-1, n) for c in ("text", "of_host", "of_domain", "said"))
            mine = _softmax(text)
            rest = np.maximum(of_host - mine, 0)  # without the page itself
            prior = (rest + LEAN * of_domain) / (rest.sum(1, keepdims=True) + LEAN)
            posterior = _softmax(text + say + np.log(prior))
            best = posterior.argmax(1)
            rows = np.arange(len(best))
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("page_id"), pa.array(names[best].tolist(), pa.string()), pa.array(posterior[rows, best]), pa.array(names[text.argmax(1)].tolist(), pa.string()),
                    frame.column("given"), frame.column("host"), pa.array(prior[rows, best]),
                ],
                ["page_id", "lang", "probability", "text_lang", "declared", "host", "prior"],
            )

    met = own.withColumn("given", F.col("declared")).withColumn("declared", F.coalesce("declared", F.lit(""))).join(said, "declared").join(priors, "host")
    return met.select("page_id", "host", "given", "text", "of_host", "of_domain", "said").mapInArrow(tidy(judge), schema)
