"""N-gram Jaccard self-join by a MinHash LSH forest.

Texts of equal word sequences are one text with copies. Each tree of the
forest is a prefix trie of part of the signature: texts lie sorted by their
path in it, and those of equal prefixes meet. The search begins with prefixes
of a tree's whole depth and shortens them, level by level, until what was
found shows that the target recall is met. What meets is compared by
signature, then verified on the exact shingle sets. Large groups are compared
in blocks: pairs are counted where they are found, and never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import member_filter, text_or_empty, written
from .components import components

_P, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Forest:
    """threshold and words: the join. The rest sets the forest."""

    threshold: float = 0.8
    words: int = 5
    trees: int = 24
    depth: int = 8
    target_recall: float = 0.9999
    #: Pairs below this estimate aren't verified; six standard errors below 0.8.
    doubtful: float = 0.6
    block_rows: int = 512
    block_shingles: int = 1 << 20

    def meets(self, length: int, similarity: float | np.ndarray) -> float | np.ndarray:
        """The probability that two texts of this similarity share a prefix of the length in some tree."""
        return 1 - (1 - similarity**length) ** self.trees


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes a text's words and shingles with array operations only."""

    def __init__(self, words: int):
        self.n = words
        self.up = self.down = np.ones(1, np.uint64)
        self.odd = np.array([pow(_P, 2 * k + 3, 1 << 64) | 1 for k in range(words)], np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
            self.up, self.down = steps(_P), steps(pow(_P, -1, 1 << 64))

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words: lower case, parted by ASCII other than letters and digits."""
        data = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_FOLD) + b" ", np.uint8)
        self._powers(len(data))
        inside = np.concatenate([[False], data != 0x20])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * self.up[: len(data)], dtype=np.uint64)])
        return _mix((sums[ends] - sums[starts]) * self.down[starts])

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Distinct shingles, sorted; fewer words than a shingle has make one, no words none."""
        k = min(self.n, len(words))
        if not k:
            return np.zeros(0, np.uint64)
        n = len(words) - k + 1
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total += words[i : i + n] * self.odd[i]
        return np.unique(_mix(total))

    def identity(self, words: np.ndarray) -> tuple[int, int]:
        """128 bits of the word sequence."""
        self._powers(len(words) + 1)
        up = self.up[1 : len(words) + 1]
        first = _mix(np.array([np.sum(words * up, dtype=np.uint64) + np.uint64(len(words))]))
        second = _mix(np.array([np.sum(_mix(words + np.uint64(1)) * up, dtype=np.uint64)]))
        return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


def signature(shingles: np.ndarray, seeds: np.ndarray) -> bytes:
    """The minimum of each seed's hash over the shingles, as 16 bits each; nothing without shingles."""
    if not len(shingles):
        return b""
    low = np.full(len(seeds), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        low = np.minimum(low, (((part ^ seeds[None, :, 0]) * seeds[None, :, 1]) >> np.uint64(32)).astype(np.uint32).min(0))
    return ((low ^ (low >> np.uint32(16))) & np.uint32(0xFFFF)).astype("<u2").tobytes()


def seeds(n: int) -> np.ndarray:
    x = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(_P))
    return np.stack([x[:n], x[n:] | np.uint64(1)], 1)


def text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def fingerprints(df: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, text_hash, k1, k2 (the word sequence), n_shingles and sig of each row."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, own = Shingler(forest.words), seeds(forest.trees * forest.depth)
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                words = shingler.words(text)
                shingles = shingler.shingles(words)
                rows.append((doc_id, text_hash, *shingler.identity(words), len(shingles), signature(shingles, own)))
            out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "k1", "k2", "n_shingles", "sig"])
            yield out.astype({"doc_id": "Int64"})

    return df.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), text_or_empty().alias("text")).mapInPandas(make, "doc_id long, text_hash long, k1 long, k2 long, n_shingles int, sig binary")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that arrive sorted by keys; holds one group and one batch."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        ids = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(batch)]
        if rest and (rest[-1][keys].to_numpy()[-1] != ids[0]).any():
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        for a, b in zip(cuts, cuts[1:]):
            if b == len(batch):
                rest.append(batch.iloc[a:b])
            elif a == 0 and rest:
                yield pd.concat([*rest, batch.iloc[a:b]])
                rest = []
            else:
                yield batch.iloc[a:b]
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    label = np.arange(len(linked))
    while True:
        reach = np.where(linked, label[None, :], len(linked)).min(1)
        new = np.minimum(label, reach)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_blocks(members: DataFrame, group: list[str], weight: str, most: int, rows: int) -> DataFrame:
    """members with i and j: the pair of blocks of its group in which a row is compared.

    A group of more than `rows` rows or `most` weight is dealt into blocks by
    hash; each pair of blocks is one unit of work. Every other group is the
    one block 0, 0.
    """
    sizes = members.groupBy(*group).agg(F.greatest(F.ceil(F.sum(weight) / most), F.ceil(F.count("*") / rows)).cast("int").alias("blocks"), F.count("*").alias("in_group"))
    dealt = members.join(sizes.filter("in_group > 1").drop("in_group"), group)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.withColumn("own", own).select("*", other)
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def _estimated(forest: Forest, length: int) -> Callable:
    """Edges between rows of a bucket whose signatures agree well enough.

    Also counts, once for each pair that meets anywhere at this length, in the
    first tree where it does: the pairs at the threshold by their estimate,
    and how many pairs of that similarity there are for each one that meets.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        met = there = 0.0

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(found, columns=["a", "b"]).astype("Int64").drop_duplicates()
            return pd.concat([out.assign(met=0.0, there=0.0), pd.DataFrame({"a": pd.array([None], "Int64"), "b": pd.array([None], "Int64"), "met": [met], "there": [there]})])

        for group in _groups(batches, ["tree", "prefix", "i", "j"]):
            group = group.sort_values("rep")
            reps, own, tree = group["rep"].to_numpy(), group["own"].to_numpy(), int(group["tree"].iloc[0])
            apart = group["i"].iloc[0] != group["j"].iloc[0]
            sigs = np.frombuffer(b"".join(group["sig"]), "<u2").reshape(len(group), forest.trees, forest.depth)
            linked = np.zeros((len(group),) * 2, bool)
            for r in range(len(group)):
                same = sigs[r] == sigs
                agree = same.mean((1, 2))
                linked[r] = agree >= forest.doubtful
                new = np.flatnonzero(agree[:r] >= forest.threshold)
                if len(new):
                    if apart:
                        new = new[own[new] != own[r]]
                    new = new[same[new, :, :length].all(2).argmax(1) == tree]
                    met += len(new)
                    there += float((1 / forest.meets(length, agree[new])).sum())
            within = own[:, None] == own[None, :]
            label = roots(linked & within | np.eye(len(reps), dtype=bool))
            if apart:  # what a block links is found in its own unit: here it is one node
                x, y = np.nonzero(linked & ~within)
                found += {(reps[max(e)], reps[min(e)]) for e in zip(label[x].tolist(), label[y].tolist())}
            else:
                found += [(reps[r], reps[root]) for r, root in enumerate(label) if root != r]
            if len(found) > 100_000:
                yield flush()
                found, met, there = [], 0.0, 0.0
        yield flush()

    return compare


def candidates(texts: DataFrame, forest: Forest) -> DataFrame:
    """Edges a, b between texts (rep, sig) that met in the forest and may be linked.

    Prefixes begin at the depth of the trees. Of the pairs found at a length,
    each stands for 1 / meets(length, similarity) pairs that are there. While
    what was found is less than the target's share of that sum, prefixes get
    shorter by one.
    """
    width = 2 * forest.depth
    tree = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
    paths = texts.select("rep", tree, "sig").withColumn("path", F.substring(F.col("sig"), F.col("tree") * width + 1, F.lit(width)))
    for length in range(forest.depth, 0, -1):
        bucket = paths.select("rep", "tree", F.substring("path", 1, 2 * length).alias("prefix"), F.lit(1).alias("one"))
        units = _in_blocks(bucket, ["tree", "prefix"], "one", forest.block_rows, forest.block_rows)
        units = written(units.select("tree", "prefix", "i", "j", "own", "rep"), "near-units")
        keys = ["tree", "prefix", "i", "j"]
        met = units.join(texts.select("rep", "sig"), "rep").repartition(*keys).sortWithinPartitions(*keys)
        edges = written(met.mapInPandas(_estimated(forest, length), "a long, b long, met double, there double"), "near-edges")
        seen = edges.agg(F.sum("met").alias("met"), F.sum("there").alias("there")).first()
        if (seen["met"] or 0.0) >= forest.target_recall * (seen["there"] or 0.0):
            break
    return edges.filter("a is not null").select("a", "b").distinct()


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes of sorted sets."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    total = np.zeros((n, n), np.int64)
    step = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, len(common), step):
        a, b = np.searchsorted(column, [at, at + step])
        part = np.zeros((n, step), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += (part @ part.T).astype(np.int64)
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _verified(forest: Forest) -> Callable:
    """Of each row and pair of blocks: linked texts and documents, and a root of what is linked."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["component", "i", "j"]):
            group = group.sort_values("rep")
            reps, own, copies = (group[c].to_numpy() for c in ("rep", "own", "copies"))
            sets = [np.frombuffer(s, "<u8") for s in group["shingles"]]
            both = shared(sets)
            size = np.diag(both)
            linked = both >= forest.threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if group["i"].iloc[0] != group["j"].iloc[0]:
                linked &= own[:, None] != own[None, :]
            yield pd.DataFrame({"rep": reps, "texts": linked.sum(1), "documents": linked @ copies, "root": reps[roots(linked | np.eye(len(reps), dtype=bool))]})

    return verify


def near_duplicates(df: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row for each row of df: doc_id, class_id, text_id, n_links, n_texts, head, text_hash.

    Two texts are linked if the Jaccard similarity of their sets of five-word
    shingles is the threshold or more. class_id is the smallest doc_id of what
    links connect, text_id that of the same word sequence. n_links counts the
    other rows that a row is linked to, copies too; n_texts counts different
    word sequences among these, without its own.

    head says whether the row is its class's first by doc_id and text_hash;
    text_hash is that of the text as it stands.

    Null texts count as empty. Texts without words have no shingle and are
    linked to each other only, as copies. Fewer than five words make one
    shingle. Rows that repeat an id are rows of their own, whatever their
    texts. Rows with a null id take part in no class but their own: class_id
    and text_id are null and the counts 0. Other columns of df are not looked
    at. No bucket is cut: groups beyond a block's bounds are compared in pairs
    of blocks.
    """
    prints = written(fingerprints(df, forest), "near-prints")
    known = prints.filter(F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    texts = known.groupBy("k1", "k2").agg(first, F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    texts = written(texts.withColumn("rep", F.monotonically_increasing_id()), "near-texts")  # the table keeps the numbers
    edges = candidates(texts.filter("n_shingles > 0").select("rep", "sig"), forest)
    grouped = components(edges).select(F.col("node").alias("rep"), F.col("root").alias("component"))
    wanted = written(grouped.join(texts.select("rep", "k1", "k2", "copies", F.col("first.doc_id").alias("doc_id")), "rep"), "near-wanted")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(forest.words)
        for batch in batches:
            rows = []
            for rep, component, k1, k2, copies, text in batch[["rep", "component", "k1", "k2", "copies", "text"]].itertuples(index=False):
                words = shingler.words(text)
                if shingler.identity(words) == (k1, k2):
                    found = shingler.shingles(words)
                    rows.append((rep, component, copies, len(found), found.astype("<u8").tobytes()))
            yield pd.DataFrame(rows, columns=["rep", "component", "copies", "n_shingles", "shingles"])

    sought = member_filter(wanted.select("doc_id"), "doc_id")  # or every text would be shuffled
    members = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter(sought).join(wanted, "doc_id")
    members = members.mapInPandas(exact, "rep long, component long, copies long, n_shingles long, shingles binary")
    members = written(members.dropDuplicates(["rep"]), "near-members")
    units = _in_blocks(members, ["component"], "n_shingles", forest.block_shingles, 4 * forest.block_rows)
    units = units.select("component", "i", "j", "own", "rep", "copies", "shingles").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    counted = written(units.mapInPandas(_verified(forest), "rep long, texts long, documents long, root long"), "near-counted")
    links = counted.groupBy("rep").agg(F.sum("texts").alias("n_texts"), F.sum("documents").alias("linked"))
    classes = components(counted.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()).withColumnRenamed("node", "rep")
    heads = texts.select("rep", "first").join(classes, "rep").groupBy("root").agg(F.min("first").alias("class_first"))
    per_text = texts.select("k1", "k2", "rep", "first", "copies").join(links, "rep", "left").join(classes, "rep", "left").join(heads, "root", "left")
    class_first = F.coalesce("class_first", "first")
    per_text = per_text.select("k1", "k2", class_first.alias("class_first"), F.col("first.doc_id").alias("text_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    head = F.struct("doc_id", "text_hash") == F.col("class_first")
    out = known.select("doc_id", "text_hash", "k1", "k2").join(per_text, ["k1", "k2"]).select("doc_id", F.col("class_first.doc_id").alias("class_id"), "text_id", "n_links", "n_texts", head.alias("head"), "text_hash")
    null = F.lit(None).cast("long")
    lonely = prints.filter(F.col("doc_id").isNull()).select("doc_id", null.alias("class_id"), null.alias("text_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"), F.lit(True).alias("head"), "text_hash")
    return out.unionByName(lonely)


def one_of_each(df: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of df that head a class of near_duplicates(df): one document of each, all its columns.

    Rows without an id stay. Of rows that repeat the id and text of a head one
    stays.
    """
    heads = found.filter(F.col("head") & F.col("doc_id").isNotNull()).groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    hashed = df.withColumn("near_text_hash", text_hash())
    same = (F.col("near_head.doc_id") == F.col("near_row.doc_id")) & (F.col("near_head.text_hash") == F.col("near_text_hash"))
    kept = hashed.alias("near_row").join(heads.alias("near_head"), same, "left_semi")
    if heads.filter("rows > 1").isEmpty():
        kept = kept.drop("near_text_hash")
    else:
        kept = kept.dropDuplicates(["doc_id", "near_text_hash"]).drop("near_text_hash")
    return kept.unionByName(df.filter(F.col("doc_id").isNull()))
