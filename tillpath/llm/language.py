"""Language identification by fusing evidence from text, markup and address.

The posterior of a language multiplies

* the likelihood of the text's letter trigrams under a model per language. Trigrams of a text are
  far from independent, so their log-likelihood is scaled down to that of ``EVIDENCE`` trigrams;
* the probability of the declared language (a markup attribute or a metadata field) given the true
  one, estimated from all texts, so that a label that is often wrong counts for little;
* a prior for the host, smoothed towards its domain, that towards the address suffix and that
  towards the whole corpus. The counts are sums of the text posteriors by host, added up level
  by level; hosts may number as many as they like, and none needs its rows in one place.

The trigram model is trained on a bounded sample of labelled texts (``sample`` texts for each label,
about, chosen by a hash of the id); everything else uses all rows. Every declared language has a model, which is
mixed with the whole corpus's trigrams, so that one of few texts lies between that and its own. Texts are scored whole, in chunks
of bytes, so memory follows neither their length nor the batch.

Rows with no letters at all get the language ``und`` and are rejected, as are null and empty texts; so
are rows whose best posterior stays below ``min_posterior``, or whose text is less likely under the
best language than under trigrams drawn at random. Null hosts have the corpus's prior and null
declarations say nothing. Repeated rows and ties (the first language in alphabetical order) are
judged alike. An empty table gives no rows. Columns named like an output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath.llm.common import kept

GRAMS = 1 << 14
EVIDENCE = 40.0
SAMPLE = 2000
AT_ONCE = 64
"""Languages scored at a time."""
SMOOTHING = 2000.0
"""Trigrams of the whole corpus that each language's own are mixed with, so that a rare one has a model too."""
PSEUDO = 20.0
"""Texts that a level of the host hierarchy is worth to the level below."""
CHUNK = 1 << 20

FOLD = np.full(256, 32, np.uint32)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its rows' offsets; a null row is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def gram_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, grams): hashed trigrams of a chunk, and where each row's begin in it.

    There is one for each byte, with its neighbours; a row's ends count as spaces. Bytes that aren't
    letters hold GRAMS.
    """
    data, offsets = _bytes_of(column)
    for low in range(0, len(data), CHUNK):
        high = min(low + CHUNK, len(data))
        letters = FOLD[data[max(low - 1, 0) : high + 1]]
        letters = np.pad(letters, (int(low == 0), int(high == len(data))), constant_values=32)
        first, middle, last = letters[:-2].copy(), letters[1:-1], letters[2:].copy()
        a = int(np.searchsorted(offsets, low, "right")) - 1
        b = int(np.searchsorted(offsets, high, "left"))
        rows = a + np.flatnonzero(offsets[a + 1 : b + 1] > offsets[a:b])
        begins, ends = offsets[rows], offsets[rows + 1]
        first[begins[begins >= low] - low] = 32
        last[ends[ends <= high] - 1 - low] = 32
        grams = ((first << 16 | middle << 8 | last) * np.uint32(2654435761)) >> np.uint32(18)
        grams[middle == 32] = GRAMS
        yield rows, np.maximum(begins, low) - low, grams


def language_code(declared: str) -> Column:
    """The primary language of a declaration such as ``en-GB``, in lower case; null if it is empty."""
    code = F.lower(F.substring_index(F.trim(F.col(declared).cast("string")), "-", 1))
    return F.when(code != "", code)


def train(
    docs: DataFrame, text: str, label: str, row_id: str, sample: int = SAMPLE
) -> tuple[list[str], np.ndarray]:
    """All declared languages and their trigrams' log-probabilities, a row per language."""
    labelled = docs.select(language_code(label).alias("label"), text, F.col(row_id).alias("id"))
    sizes = labelled.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    rows = {r["label"]: r["rows"] for r in sizes.collect()}
    languages = sorted(rows)
    if not languages:
        return [], np.zeros((0, GRAMS + 1), np.float32)
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample / rows[k]))))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) / 1_000_000.0
    chosen = labelled.where(F.col("label").isin(languages) & (draw < share[F.col("label")]))

    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for rows, starts, grams in gram_chunks(batch.column(1)):
                if not len(rows):
                    continue
                # What stands before the first row of a chunk belongs to none.
                of = np.repeat(which[rows], np.diff(np.append(starts, len(grams))))
                grams = grams[starts[0] :]
                seen, n = np.unique((of * GRAMS + grams)[grams < GRAMS], return_counts=True)
                columns = [pa.array(x.astype(np.int64)) for x in (seen // GRAMS, seen % GRAMS, n)]
                yield pa.RecordBatch.from_arrays(columns, ["language", "gram", "n"])

    counted = chosen.select("label", text).mapInArrow(count, "language long, gram long, n long")
    table = np.zeros((len(languages), GRAMS))
    sums = counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    language, gram, n = (sums.column(c).to_numpy() for c in ("language", "gram", "n"))
    table[language, gram] = n
    whole = table.sum(axis=0) + 0.5
    table += SMOOTHING * whole / whole.sum()
    logs = np.log(table / table.sum(axis=1, keepdims=True)) + math.log(GRAMS)
    return languages, np.pad(logs, ((0, 0), (0, 1))).astype(np.float32)


def with_text_scores(docs: DataFrame, text: str, model: np.ndarray) -> DataFrame:
    """``docs`` without the text, with ``__grams`` and ``__scores``: log-likelihood ratios to chance."""
    rest = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in rest]
    schema = T.StructType(
        [*rest, T.StructField("__grams", T.LongType()), T.StructField("__scores", T.ArrayType(T.FloatType()))]
    )
    parts = [np.ascontiguousarray(model[i : i + AT_ONCE].T) for i in range(0, len(model), AT_ONCE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros((batch.num_rows, sum(x.shape[1] for x in parts)))
            grams_of = np.zeros(batch.num_rows, np.int64)
            for rows, starts, grams in gram_chunks(batch.column(batch.schema.get_field_index(text))):
                if len(rows):
                    for i, part in enumerate(parts):
                        here = slice(i * AT_ONCE, i * AT_ONCE + part.shape[1])
                        scores[rows, here] += np.add.reduceat(part[grams], starts, axis=0, dtype=np.float64)
                    grams_of[rows] += np.add.reduceat((grams < GRAMS).astype(np.int64), starts)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            lists = pa.array(list(scores.astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(grams_of), lists], [*names, "__grams", "__scores"])

    return docs.select(*names, text).mapInArrow(run, schema)


def softmax(logs: Column) -> Column:
    exps = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, y: a + y))


def host_priors(texts: DataFrame, size: int) -> DataFrame:
    """(host, prior) for each host; the row with a null host has the corpus's prior."""
    sums = [F.sum(F.get("__post", F.lit(i))).alias(f"n{i}") for i in range(size)]
    n = [f"n{i}" for i in range(size)]
    hosts = texts.groupBy("__host").agg(*sums)
    hosts = hosts.withColumn("__domain", F.substring_index("__host", ".", -2))
    hosts = hosts.withColumn("__suffix", F.substring_index("__host", ".", -1))
    add = [F.sum(c).alias(c) for c in n]
    domains = hosts.where("__host IS NOT NULL").groupBy("__domain", "__suffix").agg(*add)
    suffixes = domains.groupBy("__suffix").agg(*add)
    total = hosts.agg(*add).first()
    count = sum(x or 0.0 for x in total)
    base = F.array(*(F.lit(((total[c] or 0.0) + 1.0) / (count + size)) for c in n))

    def level(df: DataFrame, above: Column, name: str) -> DataFrame:
        here = F.array(*n)
        mass = sum((F.col(c) for c in n), F.lit(0.0)) + PSEUDO
        return df.withColumn(name, F.transform(here, lambda x, i: (x + PSEUDO * F.get(above, i)) / mass))

    suffixes = level(suffixes, base, "__of_suffix").select("__suffix", "__of_suffix")
    domains = level(domains.join(suffixes, "__suffix"), F.col("__of_suffix"), "__of_domain")
    hosts = hosts.select("__host", "__domain", *n).join(
        domains.select("__domain", "__of_domain"), "__domain", "left"
    )
    above = F.coalesce("__of_domain", base)
    named = level(hosts, above, "__prior")
    prior = F.when(F.col("__host").isNull(), base).otherwise(F.col("__prior"))
    return named.select(F.col("__host").alias("__of"), prior.alias("__prior"))


def identify(
    docs: DataFrame,
    languages: list[str],
    model: np.ndarray,
    text: str = "text",
    declared: str | None = None,
    host: str | None = None,
    min_posterior: float = 0.5,
) -> DataFrame:
    """``docs`` without the text, with language, posterior, text_language, n_grams and rejected.

    Without any language to compare with, no language can be told: each is ``und``, and every row is rejected.
    """
    size = len(languages)
    if not size:
        found = docs.drop(text)
        nothing = {"language": "und", "posterior": 0.0, "text_language": "und"}
        found = found.withColumns({k: F.lit(v) for k, v in nothing.items()})
        return found.withColumns({"n_grams": F.lit(0).cast("long"), "rejected": F.lit(True)})
    code = language_code(declared) if declared else F.lit(None).cast("string")
    known = F.when(code.isin(languages), code).when(code.isNotNull(), F.lit("other"))
    slim = docs.withColumn("__declared", known.cast("string"))
    slim = slim.withColumn("__host", (F.lower(F.col(host)) if host else F.lit(None)).cast("string"))
    texts = with_text_scores(slim, text, model)
    scale = F.least(F.lit(1.0), EVIDENCE / F.greatest("__grams", F.lit(1)))
    texts = texts.withColumn("__text", F.transform("__scores", lambda x: x * scale))
    texts = kept(texts.withColumn("__post", softmax(F.col("__text"))))

    seen = texts.where("__grams > 0")
    said = {
        r["__declared"]: r
        for r in seen.where("__declared IS NOT NULL")
        .groupBy("__declared")
        .agg(*(F.sum(F.get("__post", F.lit(i))).alias(f"n{i}") for i in range(size)))
        .collect()
    }
    labels = [*languages, "other"]
    of_language = [sum((said[d][f"n{i}"] if d in said else 0.0) + 1.0 for d in labels) for i in range(size)]
    rates = [
        (d, [math.log(((said[d][f"n{i}"] if d in said else 0.0) + 1.0) / of_language[i]) for i in range(size)])
        for d in labels
    ]
    of_declared = docs.sparkSession.createDataFrame(rates, "__said string, __label array<double>")
    neutral = F.array(*[F.lit(0.0)] * size)
    priors = host_priors(seen, size)
    found = texts.join(priors.where("__of IS NOT NULL"), F.col("__host") == F.col("__of"), "left")
    whole = seen.agg(*(F.sum(F.get("__post", F.lit(i))) for i in range(size))).first()
    count = sum(x or 0.0 for x in whole)
    base = F.array(*(F.lit(((x or 0.0) + 1.0) / (count + size)) for x in whole))
    found = found.withColumn("__prior", F.coalesce("__prior", base))
    found = found.join(F.broadcast(of_declared), F.col("__declared") == F.col("__said"), "left")
    found = found.withColumn("__label", F.coalesce("__label", neutral))
    fused = F.transform("__text", lambda x, i: x + F.get("__label", i) + F.log(F.get("__prior", i)))
    found = found.withColumn("__fused", softmax(fused))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    letters = F.col("__grams") > 0
    unlike = F.array_max("__scores") < 0
    return found.withColumns(
        {
            "language": F.when(letters, best(F.col("__fused"))).otherwise("und"),
            "posterior": F.when(letters, F.array_max("__fused")).otherwise(0.0),
            "text_language": F.when(letters, best(F.col("__post"))).otherwise("und"),
            "n_grams": F.col("__grams"),
            "rejected": ~letters | unlike | (F.array_max("__fused") < min_posterior),
        }
    ).drop(*(f"__{c}" for c in "declared host grams scores text post of prior said label fused".split()))


def identified(
    docs: DataFrame,
    text: str = "text",
    declared: str = "lang",
    host: str = "source",
    row_id: str = "doc_id",
) -> DataFrame:
    """``docs`` without the rows that are rejected, the model being trained on their declared languages.

    Rows equal in id and text share a decision: they go only if each of them is rejected. Where no row declares a language,
    there is nothing to train on, and all rows are kept.
    """
    languages, model = train(docs, text, declared, row_id)
    if not languages:
        return docs
    slim = docs.select(
        F.col(row_id).alias("__id"), F.xxhash64(text).alias("__hash"), text, declared, host
    )
    found = identify(slim, languages, model, text, declared, host)
    gone = found.groupBy("__id", "__hash").agg(F.bool_and("rejected").alias("__gone")).where("__gone")
    same = docs[row_id].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text]) == gone["__hash"])
    return docs.join(gone, same, "left_anti")
