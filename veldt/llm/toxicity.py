"""Toxicity by compression distance.

Two zstandard dictionaries are made, of toxic and of ordinary text. The
ordinary one is trained by zstandard. Its training of a toxic one finds too
few of the rare words that make a text toxic (see the README for figures), so
that one's content is chosen by contrast with ordinary text. A text is cut
into short overlapping windows; each window is compressed with either
dictionary, and what the toxic one saves says how toxic the window is. A
logistic threshold over the largest savings is calibrated on labelled texts
that the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Below 64 bytes zstandard leaves literals as they are, so lengths show matches alone.
WINDOW, STRIDE = 60, 40
GRAM = 5
#: A gram marks toxic text if it stands in this share of toxic texts and in so many times the share of ordinary ones.
LEAST_SHARE, RATIO = 0.02, 20.0
#: zstandard looks for no match that begins in the last 8 bytes.
PADDING = b" " * 12
FEATURES = 5
#: The sample is dealt to so many tasks; one sends on its counts when it holds so many pieces.
TASKS, MOST_COUNTED = 32, 100_000


@dataclass(frozen=True)
class Bounds:
    """What the fit may look at: so many labelled texts of each class, none longer than `chars`."""

    toxic: int = 2000
    ordinary: int = 6000
    chars: int = 20_000
    dictionary: int = 16_000


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = 0.0

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        found = []
        for content in (self.toxic + self.ordinary, self.ordinary):
            how = zstandard.ZstdCompressionParameters.from_level(5, strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, window_log=15, hash_log=13, chain_log=14, search_log=5, write_content_size=0, write_checksum=0, write_dict_id=0)
            found.append(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how))
        return found[0], found[1]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) + self.bias, -30, 30)))


def _lengths(compressor: zstandard.ZstdCompressor, data: bytes, segments: bytes) -> np.ndarray:
    done = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments))
    return np.fromiter((len(done[i]) for i in range(len(done))), np.int64, len(done))


def features(text: str, compressors: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> list[float]:
    """Of one whole text: its three largest savings, how many windows save, and its length in windows."""
    data = text.lower().encode("utf-8", "replace")
    if not data:
        return [0.0] * FEATURES
    data += PADDING
    top: list[int] = []
    saving = windows = 0
    for at in range(0, len(data), STRIDE * 4096):  # very long texts in parts of bounded memory
        part = data[at : at + STRIDE * 4095 + WINDOW]
        starts = np.arange(0, max(min(len(part), STRIDE * 4096) - (WINDOW - STRIDE), 1), STRIDE, dtype=np.uint64)
        segments = np.empty((len(starts), 2), np.uint64)
        segments[:, 0] = starts
        segments[:, 1] = np.minimum(WINDOW, len(part) - starts.astype(np.int64))
        raw = segments.tobytes()
        saved = _lengths(compressors[1], part, raw) - _lengths(compressors[0], part, raw)
        top = sorted([*top, *np.sort(saved)[-3:].tolist()], reverse=True)[:3]
        saving += int((saved >= 2).sum())
        windows += len(starts)
    top += [0] * (3 - len(top))
    return [float(top[0]), float(top[1]), float(top[2]), math.log1p(saving), math.log1p(windows)]


def _grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def _is_mark(ours, theirs, n_toxic: int, n_ordinary: int):
    """Whether a gram of so many toxic and ordinary texts marks toxic text; of numbers or of columns."""
    ratio = (ours + 0.5) * (n_ordinary + 1) / ((theirs + 0.5) * (n_toxic + 1))
    return (ours >= max(2, LEAST_SHARE * n_toxic)) & (ratio >= RATIO)


def _runs(text: str, marks: set[str]) -> set[str]:
    own, start = set(), -1
    for i in range(len(text) - GRAM + 2):
        if text[i : i + GRAM] in marks:
            start = i if start < 0 else start
        elif start >= 0:
            own.add(text[start : i + GRAM - 1])
            start = -1
    return own


def _joined(runs: dict[str, int], size: int) -> bytes:
    content = b""
    for run in sorted(runs, key=lambda r: (-runs[r] * len(r), r)):
        piece = run.encode()
        if piece in content:
            continue
        if len(content) + len(piece) + 1 > size:
            break
        content = piece + b"\0" + content
    return content


def toxic_content(toxic: list[str], ordinary: list[str], size: int) -> bytes:
    """Dictionary content: the runs of letters that toxic texts have and ordinary ones lack.

    A run is made of GRAM-letter grams that at least LEAST_SHARE of the toxic
    texts contain, and RATIO times as large a share of them as of the ordinary
    ones, both smoothed by half a text. The runs of most texts and letters
    stand nearest to the end, where matches are cheapest.
    """
    ours = Counter(g for text in toxic for g in _grams(text))
    theirs = Counter(g for text in ordinary for g in _grams(text) if g in ours)
    marks = {g for g, n in ours.items() if _is_mark(n, theirs[g], len(toxic), len(ordinary))}
    return _joined(Counter(r for text in toxic for r in _runs(text, marks)), size)


def _counted(texts: DataFrame, pieces: Callable[[str], set[str]]) -> DataFrame:
    """piece, and the number of toxic and of ordinary texts that have it; each task adds up its own first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(p, found[1][p], found[0][p]) for p in found[0].keys() | found[1].keys()], columns=["piece", "toxic", "ordinary"])
            for counter in found:
                counter.clear()
            return out

        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                found[toxic].update(pieces(text.lower()))
                if len(found[0]) + len(found[1]) > MOST_COUNTED:
                    yield flush()
        yield flush()

    parts = texts.select("toxic", "text").mapInPandas(count, "piece string, toxic long, ordinary long")
    return parts.groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def toxic_content_of(texts: DataFrame, n_toxic: int, n_ordinary: int, size: int) -> bytes:
    """toxic_content of texts (toxic, text): grams and runs are counted in tasks; marks and runs come to the driver."""
    counted = _counted(texts, _grams)
    marks = {r["piece"] for r in counted.filter(_is_mark(F.col("toxic"), F.col("ordinary"), n_toxic, n_ordinary)).select("piece").collect()}
    runs = _counted(texts.filter("toxic = 1"), lambda text: _runs(text, marks))
    return _joined({r["piece"]: r["toxic"] for r in runs.select("piece", "toxic").collect()}, size)


def _spread(text: str) -> list[bytes]:
    data = text.encode()
    return [w for i in range(0, len(data), 2048) if len(w := data[i : i + 256]) >= 64]


def ordinary_content(windows: list[bytes], size: int = 8192) -> bytes:
    """Content of a dictionary trained on windows spread over ordinary texts."""
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()[-size * 3 // 4 :]
    except zstandard.ZstdError:  # too few windows to train on
        return b"".join(windows)[-size:]


def ordinary_windows(texts: DataFrame, most: int = 20_000) -> list[bytes]:
    """The first windows of texts (doc_id, text), in the order of doc_id."""

    @F.pandas_udf("array<binary>")
    def cut(column: pd.Series) -> pd.Series:
        return column.map(lambda text: _spread(text.lower()))

    windows = texts.select("doc_id", F.posexplode(cut("text")).alias("at", "window")).orderBy("doc_id", "at").limit(most)
    return [bytes(r["window"]) for r in windows.collect()]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], float]:
    """Newton's method with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    w = beta[:-1] / scale
    return w.tolist(), float(beta[-1] - w @ mean)


def fit(texts: DataFrame, share: float, bounds: Bounds = Bounds()) -> ToxicityModel:
    """Dictionaries from the first half of either class of texts (doc_id, toxic, text) by doc_id, thresholds from the second.

    share: of toxic texts among all labelled ones; the sample is weighted to
    it. Without texts of both classes every score is the share (0 if unknown).
    Texts stay in the tasks: ids, marks, runs, windows and features come to
    the driver.
    """
    ids = {k: [] for k in (0, 1)}
    for r in sorted(texts.select("doc_id", "toxic").collect()):  # at most bounds.toxic + bounds.ordinary rows
        ids[r["toxic"]].append(r["doc_id"])
    half = {k: (len(own) + 1) // 2 for k, own in ids.items()}
    none, last = F.lit(False), {k: own[half[k] - 1] for k, own in ids.items() if own}
    first, rest = none, none
    for k, own in ids.items():
        if own:
            early = F.col("doc_id") <= last[k]
            first |= (F.col("toxic") == k) & early
            rest |= (F.col("toxic") == k) & (~early if len(own) > 1 else F.lit(True))  # a single text is in both
    content = toxic_content_of(texts.filter(first), half[1], half[0], bounds.dictionary)
    model = ToxicityModel(content, ordinary_content(ordinary_windows(texts.filter(first & (F.col("toxic") == 0)))))
    share = min(max(share, 1e-6), 1 - 1e-6)
    if not all(ids.values()):
        model.bias = math.log(share / (1 - share))
        return model
    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for column in batches:
            yield column.map(lambda text: features(text, compressors))

    rows = sorted((1 - r["toxic"], r["doc_id"], r["features"]) for r in texts.filter(rest).select("toxic", "doc_id", measure("text").alias("features")).collect())
    x = np.array([found for _, _, found in rows])
    y = np.array([1.0 - ordinary for ordinary, _, _ in rows])
    n_toxic = int(y.sum())
    weight = np.where(y > 0, share / n_toxic, (1 - share) / (len(y) - n_toxic)) * len(y)
    model.weights, model.bias = _logistic(x, y, weight)
    return model


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> ToxicityModel:
    """Fits on labelled documents that are not held out.

    Rows with a null id or label teach nothing, nor do ids with both labels.
    The sample is the ids of lowest hash in each class, so a run repeats it.
    Its texts are written for the passes of the fit, and none comes to the
    driver.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, bounds.toxic), (0, bounds.ordinary))]
    sample = chosen[0].unionByName(chosen[1])  # at most bounds.toxic + bounds.ordinary ids
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= bounds.chars)).join(F.broadcast(sample), "doc_id")
    texts = texts.repartition(TASKS, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text an id, however often it stands
    total = sum(counts.values())
    return fit(written(texts, "toxicity-sample"), counts.get(1, 0) / total if total else 0.0, bounds)


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """documents with `score` (0 to 1) and `predicted` (1 from the threshold on).

    Whole texts are scored; null and empty ones have the features of no
    window. All rows stay; columns of these two names are replaced. One pass
    without a shuffle, and no state beyond the two dictionaries.
    """
    shipped = documents.sparkSession.sparkContext.broadcast((model.toxic, model.ordinary, model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = ToxicityModel(*shipped.value)
        compressors = own.compressors()
        for texts in batches:
            found = np.array([features(t, compressors) for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(own.score(found), dtype="float64")

    return documents.withColumn("score", score(text_or_empty())).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
