"""Language identification by language-bitmask n-gram filters.

Training counts the letter n-grams of every labelled training text (Spark
aggregation over all of them).  A language keeps the n-grams that are typical
for it (their rate is at least ``ratio`` of the highest rate in any language),
up to ``capacity`` of the most frequent: that bound makes the filter's size a
fixed parameter, whatever the corpus.  One Bloom filter per language, stored
bit-sliced: each of the ``m`` positions holds a mask of languages, so the AND
of ``k`` positions gives all languages containing an n-gram at once.

A text's language is the one with most of its n-grams, each count corrected
by its filter's false-positive rate.  Prediction reads the text alone.

Defined results: NULL text or a text without a letter is ``und`` with score
0; a text none of whose n-grams is known gets the language most frequent in
training, score 0; ties go to the first language by code point.  Without any
training text every text is ``und``.  Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

ORDERS = (2, 3, 4)
CAPACITY = 20_000      # n-grams a language keeps
RATIO = 0.25
M = 1 << 20            # positions of the filter
K = 3
CHUNK_CHARS = 1_000_000
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngrams(texts: list[str], orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes, text number of each, letters per text).  Letters are
    lower-cased; every run of other characters is one border character."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    cp = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    is_letter = _letters()[cp]
    n_letters = np.add.reduceat(is_letter, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64) if len(texts) else sizes
    cp = np.where(is_letter, cp, 0).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    cp, doc = cp[keep], doc[keep]
    keys, docs = [], []
    for n in orders:
        if len(cp) < n:
            continue
        h = np.full(len(cp) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + cp[j:len(cp) - n + 1 + j]
        # borders only at the ends of an n-gram, and all of it from one text
        ok = doc[:len(h)] == doc[n - 1:]
        for j in range(1, n - 1):
            ok &= cp[j:len(cp) - n + 1 + j] != 0
        keys.append(_mix(h[ok]))
        docs.append(doc[:len(h)][ok])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    return np.concatenate(keys), np.concatenate(docs), n_letters


def _pieces(col: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    start, size, texts = 0, 0, []
    for i in range(len(col)):
        t = col[i].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, len(col), texts


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """``text, lang`` -> ``lang, key, n`` over all rows, pre-added per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: dict[int, list] = {}

        def add(lang: int, keys: np.ndarray, counts: np.ndarray) -> None:
            parts = held.setdefault(lang, [])
            parts.append((keys, counts))
            if len(parts) >= 16:
                held[lang] = [_merge(parts)]

        for b in batches:
            langs = b.column(b.schema.get_field_index("lang"))
            for lo, hi, texts in _pieces(b.column(b.schema.get_field_index("text"))):
                keys, doc, _ = ngrams(texts)
                of = np.array([names.setdefault(x.as_py(), len(names)) for x in langs.slice(lo, hi - lo)], dtype=np.int64)
                which = of[doc]
                for lang in np.unique(which):
                    add(int(lang), *np.unique(keys[which == lang], return_counts=True))
        for name, lang in names.items():
            if lang in held:
                keys, counts = _merge(held[lang])
                for lo in range(0, len(keys), 100_000):
                    part = keys[lo:lo + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(part.view(np.int64)), pa.array(counts[lo:lo + 100_000])],
                        names=["lang", "key", "n"])

    return (labelled.select("lang", "text").mapInArrow(run, "lang string, key long, n long")
            .groupBy("lang", "key").agg(F.sum("n").alias("n")))


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


class Filter:
    """Bit-sliced Bloom filters of several languages (64 a slice)."""

    def __init__(self, langs: list[str], members: dict[str, np.ndarray], default: str, m: int = M, k: int = K):
        self.langs, self.default, self.m, self.k = langs, default, m, k
        self.slices = [np.zeros(m, dtype=np.uint64) for _ in range(-(-len(langs) // 64))]
        for i, lang in enumerate(langs):
            bit = np.uint64(1 << (i % 64))
            for pos in self._positions(members[lang]):
                np.bitwise_or.at(self.slices[i // 64], pos, bit)
        fill = [float(np.mean((self.slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(langs))]
        self.false_rate = np.array([f ** k for f in fill])
        if len(langs) <= 8:
            self.slices = [s.astype(np.uint8) for s in self.slices]

    def _positions(self, keys: np.ndarray) -> list[np.ndarray]:
        step = (keys >> np.uint64(40)) | np.uint64(1)
        return [((keys + np.uint64(j) * step) % np.uint64(self.m)).astype(np.int64) for j in range(self.k)]

    def counts(self, keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """n-grams of each text in each language's filter: [text, language]."""
        pos = self._positions(keys)
        out = np.zeros((n_docs, len(self.langs)))
        for s, table in enumerate(self.slices):
            mask = table[pos[0]]
            for p in pos[1:]:
                mask = mask & table[p]
            for i in range(64 * s, min(64 * s + 64, len(self.langs))):
                has = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                out[:, i] = np.bincount(doc, weights=has, minlength=n_docs)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        keys, doc, letters = ngrams(texts)
        total = np.bincount(doc, minlength=len(texts)).astype(float)
        hits = self.counts(keys, doc, len(texts))
        fixed = np.maximum(0.0, (hits - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        whole = fixed.sum(axis=1)
        best = fixed.argmax(axis=1)
        score = np.where(whole > 0, fixed.max(axis=1) / np.maximum(whole, 1e-300), 0.0)
        names = [("und" if n == 0 else self.langs[b] if w > 0 else self.default) for n, b, w in zip(letters, best, whole)]
        return names, np.where(letters == 0, 0.0, score)


def train(labelled: DataFrame, capacity: int = CAPACITY, ratio: float = RATIO, m: int = M, k: int = K) -> Filter | None:
    """Filter from all rows of ``text, lang`` (both not NULL).  At most
    ``capacity`` n-grams per language reach the driver."""
    counts = cut_lineage(count_ngrams(labelled))
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    if not totals:
        return None
    rate = F.col("n") / F.create_map(*[x for lang, t in sorted(totals.items()) for x in (F.lit(lang), F.lit(float(t)))])[F.col("lang")]
    top = counts.withColumn("rate", rate).groupBy("key").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("of"))  # one entry a language
    typical = top.select("key", "top", F.explode("of").alias("x")).filter(F.col("x.rate") >= ratio * F.col("top")).select(
        F.col("x.lang").alias("lang"), "key", F.col("x.n").alias("n"))
    typical = cut_lineage(typical)
    # smallest count that leaves at most ``capacity`` n-grams of a language (from the histogram of counts)
    hist = typical.groupBy("lang", "n").agg(F.count("*").alias("c")).withColumn(
        "above", F.sum("c").over(W.partitionBy("lang").orderBy(F.desc("n"))))
    least = {r["lang"]: r["least"] for r in hist.filter(F.col("above") <= capacity).groupBy("lang").agg(F.min("n").alias("least")).collect()}
    langs = sorted(totals, key=lambda x: x.encode())
    members = {lang: np.zeros(0, np.uint64) for lang in langs}
    for lang in least:
        got = typical.filter((F.col("lang") == lang) & (F.col("n") >= least[lang])).select("key").limit(capacity).toPandas()
        members[lang] = got["key"].to_numpy().view(np.uint64)
    return Filter(langs, members, max(langs, key=lambda x: totals[x]), m, k)


def predict(df: DataFrame, model: Filter | None, text: str = "text") -> DataFrame:
    """``df`` without its text column, plus ``lang_pred`` and ``score``."""
    rest = [c for c in df.columns if c != text]
    if model is None:
        return df.select(*[F.col(f"`{c}`") for c in rest], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    bc = df.sparkSession.sparkContext.broadcast(model)
    at, pick = df.columns.index(text), [df.columns.index(c) for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = bc.value
        for b in batches:
            for lo, hi, texts in _pieces(b.column(at)):
                names, score = f.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).slice(lo, hi - lo) for i in pick], pa.array(names, pa.string()), pa.array(score)],
                    names=[*rest, "lang_pred", "score"])

    from pyspark.sql import types as T
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(run, schema)


def held_out(folds: int):
    """Whether crc32(doc_id as text) leaves 1 (a NULL id: no)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 1, F.lit(False))


def op8_langid(docs: DataFrame) -> DataFrame:
    """Train on the training fold, predict every document."""
    train_rows = docs.filter(~held_out(3) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    model = train(train_rows)
    return predict(docs.select("doc_id", held_out(3).alias("held_out"), "text"), model)
