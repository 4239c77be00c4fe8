"""Language identification by Bayesian evidence fusion.

For each row the log-probabilities of the languages add up from
- the text: a multinomial over hashed byte trigrams, fitted on a bounded sample of each label's rows and damped, as neighbouring
  trigrams are not independent; a further class without language, "und", takes all trigrams as equally likely;
- the declared language (a document's or a page's markup attribute), right with probability RELIABILITY;
- the host: the share of each language among its other rows, smoothed towards that of its domain, that towards its address
  suffix's, and that towards the corpus's. The shares come from grouped aggregation of the text probabilities of all rows;
  a row's own text is taken out of each level, so that it does not count twice.

Text is read once; scores without text are written to the shared folder, aggregated by host with map-side sums, and joined to
the host priors, where AQE splits a hot host. The fitted table has the size buckets x languages, 256 KB for each label that occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.llm.common import AT_ONCE, map_texts, materialize, row_hash, small_batches, without_rows

BUCKETS = 1 << 16
#: Labelled rows in the sample of each label (expected number); a label with fewer rows gives them all.
SAMPLE_ROWS = 4000
#: Weight of one trigram's evidence against that of a declaration or a host.
DAMPING = 0.25
RELIABILITY = 0.9
#: Rows of its parent's distribution that smooth a host, a domain or a suffix.
SMOOTHING = 10.0
#: Share of rows expected to be in no language.
NO_LANGUAGE = 0.01
UND = "und"
LEAST_PROBABILITY = 0.7

#: Every ASCII character but letters becomes a space; other bytes stay.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_SPACES = re.compile(rb" +")


def letters(text: str | None) -> bytes:
    """The lower-cased letters in UTF-8, words between single spaces."""
    return b" " + _SPACES.sub(b" ", (text or "").lower().encode("utf-8", "replace").translate(_LETTERS)).strip() + b" "


def trigrams(raw: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two."""
    x = raw.astype(np.uint32)
    x = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (x * np.uint32(2654435769)) >> np.uint32(16)


def _batches(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows, their joined bytes, and where each begins; rows of about AT_ONCE bytes together."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        part = letters(text) + b"\0\0"  # no trigram across rows
        rows.append(i)
        parts.append(part)
        size += len(part)
        if size >= AT_ONCE or i + 1 == len(texts):
            yield rows, np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])]
            rows, parts, size = [], [], 0


def _valid(raw: np.ndarray) -> np.ndarray:
    return (raw[:-2] != 0) & (raw[1:-1] != 0) & (raw[2:] != 0)


def normalised(label: Column) -> Column:
    """A label or declaration in lower case, without its region; null if nothing is left."""
    return F.nullif(F.trim(F.lower(F.substring_index(label.cast("string"), "-", 1))), F.lit(""))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram bucket | language) - log P(bucket | und), of shape (BUCKETS, languages), float32.

    Every label with a trigram is a language; labels are normalised as declarations are. Fitted on about SAMPLE_ROWS rows
    of each label, chosen by a hash of the id. Counts are summed by Spark; the table of at most BUCKETS x languages sums
    reaches the driver.
    """
    label = normalised(F.col(label_col))
    known = labelled.select(F.col(id_col).alias("id"), label.alias("label"), F.col(text_col).cast("string").alias("text")).where("label is not null")
    sizes = known.groupBy("label").count()
    languages = sorted(r.label for r in sizes.select("label").collect())
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    shares = F.broadcast(sizes.select(F.col("label").alias("of"), F.least(F.lit(1.0), F.lit(float(SAMPLE_ROWS)) / F.col("count")).alias("share")))
    chosen = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) <= F.col("share") * F.lit(float(1 << 40))
    sample = known.join(shares, F.col("label") == F.col("of")).where(chosen).select("label", "text")
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in small_batches(batches, 1):
            label = batch.column(0).to_pylist()
            for rows, raw, begin in _batches(batch.column(1).to_pylist()):
                gram, ok = trigrams(raw), _valid(raw)
                owner = np.repeat([place[label[i]] for i in rows], np.diff(begin))[:-2]
                np.add.at(sums, (owner[ok], gram[ok]), 1)
        where = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(where[0] * BUCKETS + where[1], pa.int64()), pa.array(sums[where], pa.int64())], ["cell", "n"])

    table = map_texts(sample, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(len(languages) * BUCKETS)
    sums[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    sums = sums.reshape(len(languages), BUCKETS).T
    seen = sums.sum(0) > 0
    languages, sums = [x for x, ok in zip(languages, seen, strict=True) if ok], sums[:, seen]
    # a share of the uniform distribution keeps unseen trigrams possible
    p = 0.95 * sums / np.maximum(sums.sum(0), 1) + 0.05 / BUCKETS
    return languages, np.log(p * BUCKETS).astype(np.float32)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


#: Labels below a country's suffix under which names are registered, as in example.co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "go", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def _named(host: Column) -> Column:
    """Whether a host is a name with a dot, not an address in numbers."""
    return F.contains(host, F.lit(".")) & ~F.rlike(host, F.lit(r"^[0-9.]+$|:"))


def domain_of(host: Column) -> Column:
    """The registered name: the last two labels of a host, or three below such as co.uk; null without a dot and for addresses."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    under = (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL) & (n > 2)
    return F.when(_named(host), F.when(under, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)))


def suffix_of(host: Column) -> Column:
    return F.when(_named(host), F.substring_index(host, ".", -1))


def host_sums(scored: DataFrame, n: int) -> tuple[DataFrame, tuple[list[float], int]]:
    """scored (host, domain, suffix, p array of n probabilities) -> (host, hs, hn, ds, dn, ss, sn), the sums of p and the rows of
    each host, of its domain and of its suffix (null without one); and the sums and rows of all."""

    def sums(keys: list[str], rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(F.col(f"s{i}")).alias(f"s{i}") for i in range(n)], F.sum("rows").alias("rows"))

    def packed(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(F.col(key).alias(f"_{name}"), F.array(*[F.col(f"s{i}") for i in range(n)]).alias(f"{name}s"), F.col("rows").alias(f"{name}n"))

    each = scored.select("host", "domain", "suffix", *[F.col("p")[i].alias(f"s{i}") for i in range(n)], F.lit(1).alias("rows"))
    hosts = materialize(sums(["host", "domain", "suffix"], each))
    whole = hosts.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)], F.sum("rows").alias("rows")).first()
    suffixes = packed(sums(["suffix"], hosts.where("suffix is not null")), "suffix", "s")
    domains = packed(sums(["domain"], hosts.where("domain is not null")), "domain", "d")
    out = hosts.where("host is not null").select("host", "domain", "suffix", F.array(*[F.col(f"s{i}") for i in range(n)]).alias("hs"), F.col("rows").alias("hn"))
    out = out.join(domains, F.col("domain") == F.col("_d"), "left").join(suffixes, F.col("suffix") == F.col("_s"), "left")
    return out.select("host", "hs", "hn", "ds", "dn", "ss", "sn"), ([float(whole[f"s{i}"] or 0) for i in range(n)], int(whole["rows"] or 0))


def prior(own: Column, counted: Column, whole: tuple[list[float], int]) -> Column:
    """The prior of a row with the columns of host_sums(): own is the row's array of probabilities, counted whether it is in
    the sums. Each level is smoothed towards the one above it, the corpus towards even shares."""
    sums, rows = whole
    mine = F.when(counted, 1).otherwise(0)

    def level(total: Column, n: Column, above: Column) -> Column:
        # sums in double precision may fall a trifle below zero
        rest = F.zip_with(total, own, lambda t, o: F.greatest(F.lit(0.0), t - o * mine))
        return F.zip_with(rest, above, lambda r, a: (r + SMOOTHING * a) / (n - mine + SMOOTHING))

    out = level(F.array(*map(F.lit, sums)), F.lit(rows), F.array(*[F.lit(1 / len(sums))] * len(sums)))
    for name in "sdh":
        out = F.when(F.col(f"{name}s").isNotNull(), level(F.col(f"{name}s"), F.col(f"{name}n"), out)).otherwise(out)
    return out


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """One row per input row: id_col, language, probability, text_language, n_letters (bytes), kept.

    A row whose declared language has no model is kept, in that language if no other is found, unless its text has no letter.
    Any other row is rejected (kept false) if no language reaches LEAST_PROBABILITY or its text has no letter; its language is
    "und" where that class is the most likely or the text has no letter. Null texts count as empty; a null or unknown
    declaration and a null host are no evidence; a host without a dot has no domain and no suffix. Rows that repeat are
    each identified, an empty table gives no rows, other columns are ignored, whatever their names.
    """
    return _identified(rows, model, id_col, text_col, declared_col, host_col).drop("_hash")


def _identified(rows: DataFrame, model: tuple[list[str], np.ndarray], id_col: str, text_col: str, declared_col: str, host_col: str) -> DataFrame:
    """identify() with _hash, which tells the rows of an id apart by what was judged."""
    languages, weights = model
    n = len(languages)
    host = F.lower(F.col(host_col).cast("string"))
    named = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), normalised(F.col(declared_col)).alias("declared"), host.alias("host"), row_hash(*[F.col(c) for c in (text_col, declared_col, host_col)]).alias("hash"))
    if not n:
        return named.select(F.col("id").alias(id_col), F.lit(UND).alias("language"), F.lit(1.0).alias("probability"), F.lit(UND).alias("text_language"), F.lit(0).cast("long").alias("n_letters"), F.lit(False).alias("kept"), F.col("hash").alias("_hash"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            texts = batch.column(1).to_pylist()
            like, size = np.zeros((len(texts), n + 1)), np.zeros(len(texts), np.int64)
            for at, raw, begin in _batches(texts):
                gram, ok = trigrams(raw), _valid(raw)
                got = weights[gram]
                got[~ok] = 0
                # each row ends with two bytes without a trigram, so no range is empty
                like[at, :n] = np.add.reduceat(np.vstack([got, np.zeros((2, n), np.float32)]), begin[:-1], dtype=np.float64)
                size[at] = np.add.reduceat((raw > 0x20).astype(np.int64), begin[:-1])
            text = _log_softmax(DAMPING * like + np.log([(1 - NO_LANGUAGE) / n] * n + [NO_LANGUAGE]))
            values = pa.array(text.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (n + 1)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), lists, pa.array(size)], ["id", "declared", "host", "hash", "text", "n_letters"])

    schema = T.StructType([named.schema["id"], T.StructField("declared", T.StringType()), T.StructField("host", T.StringType()), named.schema["hash"], T.StructField("text", T.ArrayType(T.DoubleType())), T.StructField("n_letters", T.LongType())])
    scored = materialize(map_texts(named, score, schema).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    # what texts without a letter would add is the prior itself, so they do not count
    own, counted = F.transform("text", lambda x: F.exp(x)), F.col("n_letters") > 0
    hosts, whole = host_sums(scored.where(counted).select("host", "domain", "suffix", own.alias("p")), n + 1)
    joined = scored.join(materialize(hosts), "host", "left")
    # the text's probabilities hold an even prior, which the host's replaces
    base = F.array(*[F.lit(float(x)) for x in np.log([(1 - NO_LANGUAGE) / n] * n + [NO_LANGUAGE])])
    spread = (1 - RELIABILITY) / max(1, n)
    says = F.array(*[F.when(F.col("declared") == x, RELIABILITY).otherwise(spread) for x in languages], F.lit(spread))
    no_word = F.col("declared").isNull() | ~F.col("declared").isin(languages)
    logs = F.transform(prior(own, counted, whole), lambda q: F.log(q))
    fused = F.zip_with(F.zip_with("text", base, lambda a, b: a - b), F.zip_with(logs, says, lambda a, b: a + F.when(no_word, 0.0).otherwise(F.log(b))), lambda a, b: a + b)
    out = joined.select("id", "hash", "n_letters", "text", "declared", fused.alias("f")).withColumn("top", F.array_max("f"))
    total = F.aggregate("f", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    names = F.array(*map(F.lit, [*languages, UND]))
    best = F.element_at(names, F.array_position("f", F.col("top")).cast("int"))
    blank = F.col("n_letters") == 0
    out = out.select(
        F.col("id").alias(id_col),
        F.when(blank, UND).otherwise(best).alias("language"),
        (F.lit(1.0) / total).alias("probability"),
        F.when(blank, UND).otherwise(F.element_at(names, F.array_position("text", F.array_max("text")).cast("int"))).alias("text_language"),
        "n_letters",
        "declared",
        F.col("hash").alias("_hash"),
    )
    sure = (F.col("language") != UND) & (F.col("probability") >= LEAST_PROBABILITY)
    unmodelled = F.col("declared").isNotNull() & ~F.col("declared").isin(languages) & (F.col("n_letters") > 0)
    language = F.when(unmodelled & ~sure, F.col("declared")).otherwise(F.col("language")).alias("language")
    return out.select(id_col, language, "probability", "text_language", "n_letters", (sure | unmodelled).alias("kept"), "_hash")


def page_rows(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, text without markup, lang as the html element declares it, source: the host).

    A script, style or comment that is not closed reaches to the end of the page, as it does in browsers, so each page takes
    linear time.
    """
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b(?:.*?</\1\s*>|.*)|<!--(?:.*?-->|.*)|<[^<>]*>", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?([a-z]+)", 1), F.lit(""))
    host = F.nullif(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return pages.select("page_id", F.regexp_replace(bare, r"&[#A-Za-z0-9]+;", " ").alias("text"), declared.alias("lang"), host.alias("source"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """docs without the rows whose language identify() rejects, with the columns of docs.

    Rows are told apart by id, text, declaration and host, so of rows that repeat an id each goes or stays by its own; rows
    with a null id are judged like any other. A table without rows gives none.
    """
    found = _identified(docs, fit(docs, text_col, declared_col, id_col), id_col, text_col, declared_col, host_col)
    return without_rows(docs, id_col, [text_col, declared_col, host_col], found.where(~F.col("kept")).select(id_col, "_hash"))
