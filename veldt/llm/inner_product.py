"""Approximate maximum inner product search with score-aware quantisation.

Vectors are coded by four bits for every two dimensions. The codes minimise a
loss in which error parallel to the vector, which moves its large inner
products, weighs more than error at right angles to it. Queries go through
the codes with tables of their products with all codewords. With each code
stands how far it is from its vector; a row whose score by code, raised by
what that error may hide, reaches the worst of the best found so far is ranked
again by its exact product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CODEWORDS, WIDTH = 16, 2


@dataclass(frozen=True)
class Search:
    """k nearest; the rest sets fit and blocks.

    slack: how many times its usual size the error of a code's score may have.
    Error at right angles to a query of d dimensions is usually its length
    over the root of d; with the root of d as slack no row is lost at all.
    query_block bounds a block of queries and its tables, chunk the rows that
    pass through it at a time.
    """

    k: int = 20
    slack: float = 4.0
    sample: int = 20_000
    threshold: float = 0.2
    rounds: int = 6
    query_block: int = 512
    chunk: int = 512


@dataclass
class Codebook:
    dim: int
    words: np.ndarray  # subspaces, codewords, width
    parallel: float  # weight of parallel error; error at right angles weighs 1

    def _split(self, x: np.ndarray) -> np.ndarray:
        spaces = self.words.shape[0]
        padded = np.zeros((len(x), spaces * WIDTH))
        padded[:, : self.dim] = x
        return padded.reshape(len(x), spaces, WIDTH)

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the weighted loss."""
        parts = self._split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        codes = np.empty(parts.shape[:2], np.int64)
        for m in range(parts.shape[1]):
            codes[:, m] = ((parts[:, m, None, :] - self.words[m][None]) ** 2).sum(2).argmin(1)
        rest = parts - np.take_along_axis(self.words[None], codes[:, :, None, None], 2)[:, :, 0]
        along = (unit * rest).sum((1, 2))
        for _ in range(sweeps):
            for m in range(parts.shape[1]):
                trial = parts[:, m, None, :] - self.words[m][None]
                others = along - (unit[:, m] * rest[:, m]).sum(1)
                loss = (trial**2).sum(2) + (self.parallel - 1) * (others[:, None] + (unit[:, m, None, :] * trial).sum(2)) ** 2
                codes[:, m] = loss.argmin(1)
                rest[:, m] = np.take_along_axis(trial, codes[:, m, None, None], 1)[:, 0]
                along = others + (unit[:, m] * rest[:, m]).sum(1)
        return codes

    def error(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The distance of each vector from its codewords."""
        return np.linalg.norm((self._split(x) - np.take_along_axis(self.words[None], codes[:, :, None, None], 2)[:, :, 0]).reshape(len(x), -1), axis=1)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte; an odd last subspace has a byte of its own."""
        if codes.shape[1] % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), np.int64)])
        return (codes[:, ::2] * CODEWORDS + codes[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and code byte, the 256 sums of two products, as whole numbers; and their unit."""
        parts = self._split(queries)
        single = np.einsum("qmw,mkw->qmk", parts, self.words)
        if single.shape[1] % 2:
            single = np.concatenate([single, np.zeros((len(single), 1, CODEWORDS))], 1)
        pairs = (single[:, ::2, :, None] + single[:, 1::2, None, :]).reshape(len(single), -1, 256)
        unit = np.maximum(np.abs(pairs).max((1, 2)), 1e-300) / 2**20
        return np.rint(pairs / unit[:, None, None]).astype(np.int32), unit


def fit(sample: np.ndarray, search: Search) -> Codebook:
    """Alternates coding the sample and solving each codeword for the weighted loss."""
    dim = sample.shape[1]
    spaces = (dim + WIDTH - 1) // WIDTH
    t2 = search.threshold**2
    book = Codebook(dim, np.zeros((spaces, CODEWORDS, WIDTH)), max(1.0, (dim - 1) * t2 / (1 - t2)))
    parts = book._split(sample)
    picks = np.random.default_rng(17)
    for m in range(spaces):
        book.words[m] = parts[picks.integers(0, len(parts), CODEWORDS), m]
    unit = parts / np.maximum(np.linalg.norm(sample, axis=1), 1e-300)[:, None, None]
    extra = book.parallel - 1
    for _ in range(search.rounds):
        codes = book.encode(sample, 1)
        rest = parts - np.take_along_axis(book.words[None], codes[:, :, None, None], 2)[:, :, 0]
        along = (unit * rest).sum((1, 2))
        for m in range(spaces):
            u, others = unit[:, m], along - (unit[:, m] * rest[:, m]).sum(1)
            weight = np.eye(WIDTH)[None] + extra * u[:, :, None] * u[:, None, :]
            right = np.einsum("nij,nj->ni", weight, parts[:, m]) + extra * u * others[:, None]
            left_sum, right_sum = np.zeros((CODEWORDS, WIDTH, WIDTH)), np.zeros((CODEWORDS, WIDTH))
            np.add.at(left_sum, codes[:, m], weight)
            np.add.at(right_sum, codes[:, m], right)
            used = np.bincount(codes[:, m], minlength=CODEWORDS) > 0
            book.words[m][used] = np.linalg.solve(left_sum[used], right_sum[used][:, :, None])[:, :, 0]
            rest[:, m] = parts[:, m] - book.words[m][codes[:, m]]
            along = others + (u * rest[:, m]).sum(1)
    return book


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite and not all zero; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, summed in the order of the components."""
    return np.cumsum(queries * rows, axis=1)[:, -1] if queries.shape[1] else np.zeros(len(queries))


class _Block:
    """A block of queries and the best rows that it has met."""

    def __init__(self, book: Codebook, search: Search, ids: list[int], vectors: list):
        self.search, self.ids = search, np.array(ids, np.int64)
        self.vectors = np.array(vectors, np.float64)
        self.tables, self.unit = book.tables(self.vectors)
        self.reach = search.slack * np.linalg.norm(self.vectors, axis=1) / math.sqrt(book.dim)
        self.worst = np.full(len(ids), -np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def meet(self, vec_ids: np.ndarray, packed: np.ndarray, errors: np.ndarray, rows: np.ndarray) -> None:
        total = np.zeros((len(self.ids), len(vec_ids)), np.int32)
        for m in range(packed.shape[1]):
            total += np.take(self.tables[:, m], packed[:, m], axis=1)
        may = total * self.unit[:, None] + self.reach[:, None] * errors[None] >= self.worst[:, None]
        may &= self.ids[:, None] != vec_ids[None]
        asking, found = np.nonzero(may)
        for at in range(0, len(asking), 1 << 16):  # pairs at a time
            q, r = asking[at : at + (1 << 16)], found[at : at + (1 << 16)]
            exact = _products(self.vectors[q], rows[r])
            good = exact >= self.worst[q]
            q, r, exact = q[good], r[good], exact[good]
            for own in np.unique(q).tolist():
                mine = q == own
                known, scores = self.best[own]
                known, scores = np.concatenate([known, vec_ids[r[mine]]]), np.concatenate([scores, exact[mine]])
                order = np.lexsort((known, -scores))[: self.search.k]
                self.best[own] = known[order], scores[order]
                if len(order) == self.search.k:
                    self.worst[own] = scores[order[-1]]

    def result(self) -> pd.DataFrame:
        sizes = [len(known) for known, _ in self.best]
        return pd.DataFrame({"query_id": np.repeat(self.ids, sizes), "rank": np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes]), "vec_id": np.concatenate([known for known, _ in self.best]), "score": np.concatenate([scores for _, scores in self.best])})


def _scan(book: Codebook, search: Search):
    """Rows of one block: its queries, then chunks of the index."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, vectors, block = None, [], [], None
        for batch in batches:
            for own, kind, query_id, vector, chunk_ids, codes, errors, raw in batch[["block", "kind", "query_id", "embedding", "ids", "codes", "errors", "raw"]].itertuples(index=False):
                if own != now:
                    if block is not None:
                        yield block.result()
                    now, ids, vectors, block = own, [], [], None
                if kind == 0:
                    ids.append(query_id)
                    vectors.append(np.asarray(vector, np.float64))
                    continue
                if not ids:
                    continue
                block = block or _Block(book, search, ids, vectors)
                vec_ids = np.frombuffer(chunk_ids, "<i8")
                block.meet(vec_ids, np.frombuffer(codes, np.uint8).reshape(len(vec_ids), -1), np.frombuffer(errors, "<f8"), np.frombuffer(raw, "<f4" if len(raw) == 4 * len(vec_ids) * book.dim else "<f8").reshape(len(vec_ids), -1).astype(np.float64))
        if block is not None:
            yield block.result()

    return scan


def nearest(vectors: DataFrame, is_query: Column, search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for each query.

    vectors needs vec_id and embedding; other columns are not looked at.
    Nearest first by inner product in double precision, ties to the smaller
    vec_id, search.k at most; a query does not find itself. Rows with a null
    id or an unusable vector take no part, nor do vectors of another length
    than most rows have; of rows that repeat an id the one of the smallest
    vector counts. The fit sees search.sample vectors, the index holds all.

    The queries are a stated set: all rows pass each block of them in chunks,
    so memory is bounded by the block and the chunk, and a query's shortlist
    is whatever the bound lets through, however many that are. A block of
    queries reads the whole index once.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = written(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-vectors")
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.filter(F.size("embedding") == lengths["n"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(search.sample).select("embedding").toPandas()
    book = fit(np.array(sample["embedding"].tolist(), np.float64), search)

    single = rows.schema["embedding"].dataType.elementType.typeName() == "float"

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            for at in range(0, len(ids), search.chunk):
                x = np.array(batch["embedding"].iloc[at : at + search.chunk].tolist(), np.float64)
                codes = book.encode(x)
                yield pd.DataFrame({"ids": [ids[at : at + search.chunk].astype("<i8").tobytes()], "codes": [book.pack(codes).tobytes()], "errors": [book.error(x, codes).astype("<f8").tobytes()], "raw": [x.astype("<f4" if single else "<f8").tobytes()]})

    index = written(rows.mapInPandas(code, "ids binary, codes binary, errors binary, raw binary"), "ann-index")
    queries = rows.filter(is_query)
    n, slots = queries.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // search.query_block), min(slots, -(-n // 64)))  # small sets make small blocks, for all executors
    none = lambda kind: F.lit(None).cast(kind)
    asked = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("query_id"), "embedding", *[none("binary").alias(c) for c in index.columns])
    chunks = index.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), none("long").alias("query_id"), none(rows.schema["embedding"].dataType).alias("embedding"), *index.columns)
    work = asked.unionByName(chunks).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    return work.mapInPandas(_scan(book, search), "query_id long, rank int, vec_id long, score double")
