"""Near-duplicate texts by Golay-code fuzzy hashing (problem 1).

A text's fingerprint has ``SEGMENTS`` segments. Segment i is tied to the text's min-wise run of
three words under hash i; its 23 bits are majority votes of the words around that run, so small
edits beside it flip few bits. Each segment is decoded to the indices of the Golay codewords near
it, one or six of them, and (segment, run, codeword) is a key. Two texts share a key unless in every
segment either the runs differ or more than two bits do: at a similarity of s all SEGMENTS runs
differ with a chance of (1 - s) ** SEGMENTS. Key rows carry a 128-bit sketch of one-bit minima,
compared inside the join, and what is left is verified exactly on the whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.golay import BITS, fuzzy_keys
from skeinlake.session import cut_lineage

SEGMENTS = 8
REACH = 8  # words on either side of the run
SKETCH = 128
RUN = 3
HOT_BUCKET = 1000
SMALL = 1_000_000  # rows of 16 bytes that may be broadcast
NONE = np.uint64(2**64 - 1)
FEATURES = "id long, h1 long, h2 long, s1 long, s2 long, keys array<long>, nibbles array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _salt(i: int) -> np.uint64:
    return np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)


def fingerprints(word_hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, ...]:
    """(runs of each segment, 23-bit words, two sketch halves, four more bits of each minimum) of texts laid end to end, each of ``RUN`` words or more."""
    n = len(word_hashes)
    ends = starts + lengths
    with np.errstate(over="ignore"):
        run = _mix(word_hashes[:-2] * np.uint64(3) + _mix(word_hashes[1:-1] + np.uint64(77)) * np.uint64(5) + _mix(word_hashes[2:] + np.uint64(991)) * np.uint64(7))
        run = np.concatenate([run, np.zeros(2, np.uint64)])
        outside = np.zeros(n, bool)
        for k in range(1, RUN):
            outside[ends - k] = True
        vote = _mix(word_hashes + np.uint64(12345))
        runs, words = np.empty((len(starts), segments), np.uint64), np.empty((len(starts), segments), np.int64)
        for i in range(segments):
            v = _mix(run ^ _salt(i))
            v[outside] = NONE
            least = np.minimum.reduceat(v, starts)
            at = np.flatnonzero(v == np.repeat(least, lengths))
            owner = np.searchsorted(starts, at, side="right") - 1
            at = at[np.unique(owner, return_index=True)[1]]
            votes = np.zeros((len(starts), BITS), np.int32)
            for o in range(-REACH, RUN + REACH):
                q = at + o
                ok = (q >= starts) & (q < ends)
                h = vote[np.where(ok, q, 0)]
                for b in range(BITS):
                    votes[:, b] += np.where(ok, ((h >> np.uint64(b)) & np.uint64(1)).astype(np.int32) * 2 - 1, 0)
            runs[:, i] = least
            words[:, i] = ((votes > 0).astype(np.int64) << np.arange(BITS)).sum(1)
        # SKETCH minima, each under its own multiply-shift hash: one bit of each for the join, four for the test after it
        halves = np.zeros((2, len(starts)), np.uint64)
        nibbles = np.zeros((len(starts), SKETCH // 16), np.uint64)
        base = np.where(outside, np.uint64(0), run | np.uint64(1))
        for j in range(SKETCH):
            v = base * (_salt(1000 + j) | np.uint64(1))
            v ^= v >> np.uint64(29)
            v[outside] = NONE
            least = np.minimum.reduceat(v, starts)
            least = _mix(least)
            halves[j // 64] |= (least & np.uint64(1)) << np.uint64(j % 64)
            nibbles[:, j // 16] |= ((least >> np.uint64(8)) & np.uint64(15)) << np.uint64(j % 16 * 4)
    return runs, words, halves[0], halves[1], nibbles


TOKEN = re.compile(r"[⺀-鿿가-힣豈-﫿฀-๿຀-໿က-႟ក-៿]|[^\s⺀-鿿가-힣豈-﫿฀-๿຀-໿က-႟ក-៿]+")


def split_words(text: str) -> list[str]:
    """Lower-cased text, split at white space."""
    return text.lower().split()


def tokens(text: str) -> list[str]:
    """As split_words, but characters of scripts without blanks are words of their own."""
    return TOKEN.findall(text.lower())


def _features(min_words: int, split: Callable[[str], list[str]] = split_words):
    """Features of texts of ``min_words`` words or more; texts of fewer than RUN words, if any, have no keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            ids, lengths, flat, full, few = [], [], [], [], []
            for i, text in zip(pdf["id"].to_numpy(), pdf["text"], strict=True):
                if text is None:
                    continue
                words = split(text)
                if len(words) < max(min_words, RUN):
                    if len(words) >= max(min_words, 1):
                        few.append((i, xxhash.xxh3_128_intdigest("\n".join(words))))
                    continue
                for w in words:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    flat.append(h)
                ids.append(i)
                lengths.append(len(words))
                full.append(xxhash.xxh3_128_intdigest("\n".join(words)))
            if len(known) > 1 << 20:
                known.clear()
            if few:
                top, low = np.array([f >> 64 for _, f in few], np.uint64).view(np.int64), np.array([f & (2**64 - 1) for _, f in few], np.uint64).view(np.int64)
                yield pd.DataFrame({"id": [i for i, _ in few], "h1": top, "h2": low, "s1": np.int64(0), "s2": np.int64(0), "keys": [np.empty(0, np.int64)] * len(few), "nibbles": [np.zeros(SKETCH // 16, np.int64)] * len(few)})
            if not ids:
                continue
            ln = np.array(lengths)
            st = np.concatenate([[0], np.cumsum(ln)[:-1]])
            runs, words23, s1, s2, nibbles = fingerprints(np.array(flat, np.uint64), st, ln)
            index, count = fuzzy_keys(words23)
            with np.errstate(over="ignore"):
                seg = np.array([_salt(i) for i in range(runs.shape[1])], np.uint64)
                keys = _mix((runs ^ seg)[..., None] + index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            valid = np.arange(keys.shape[2]) < count[..., None]
            yield pd.DataFrame({
                "id": ids, "h1": np.array([f >> 64 for f in full], np.uint64).view(np.int64), "h2": np.array([f & (2**64 - 1) for f in full], np.uint64).view(np.int64),
                "s1": s1.view(np.int64), "s2": s2.view(np.int64), "keys": [k[v] for k, v in zip(keys, valid, strict=True)], "nibbles": list(nibbles.view(np.int64)),
            })

    return run


def agreement_floor(threshold: float, deviations: float | None = 3.5) -> int:
    """Sketch bits that texts at ``threshold`` agree in, less ``deviations`` standard deviations; 0 without."""
    p = (1 + threshold) / 2
    return 0 if deviations is None else int(SKETCH * p - deviations * (SKETCH * p * (1 - p)) ** 0.5)


def nibbles_floor(threshold: float, deviations: float | None = 4.0) -> int:
    """As agreement_floor, for minima of which four bits are kept."""
    p = threshold + (1 - threshold) / 16
    return 0 if deviations is None else int(SKETCH * p - deviations * (SKETCH * p * (1 - p)) ** 0.5)


def _jaccard(a: str, b: str, split: Callable[[str], list[str]] = split_words, run: int = RUN) -> float:
    x, y = split(a), split(b)
    x, y = set(zip(*(x[k:] for k in range(run)))), set(zip(*(y[k:] for k in range(run))))
    both = len(x & y)
    return both / max(len(x) + len(y) - both, 1)


def _equal_nibbles(x: str, y: str) -> Column:
    total = F.lit(SKETCH)
    for i in range(SKETCH // 16):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total - F.bit_count(d)
    return total


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint when a count finds at most ``rows`` rows in it; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def candidate_pairs(docs: DataFrame, threshold: float, exact: bool = False) -> DataFrame:
    """(a, b), a < b: rows of (id, s1, s2, keys) that share a key and whose sketches allow ``threshold``.

    No bucket is cut. One with more than HOT_BUCKET rows is split: a row meets the whole bucket in
    the cell of its own salt, so that a cell has HOT_BUCKET rows on one side.
    """
    floor = agreement_floor(threshold, None) if exact else agreement_floor(threshold)
    rows = docs.select("id", "s1", "s2", F.explode("keys").alias("key"))
    hot = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET).select("key", F.ceil(F.col("n") / HOT_BUCKET).cast("int").alias("cells")))

    def meet(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        agree = SKETCH - F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) - F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
        same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in on]
        return x.join(y, [*same, F.col("x.id") < F.col("y.id"), agree >= floor]).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    if hot.isEmpty():
        return meet(rows, rows, ["key"]).distinct()
    known = if_small(hot, SMALL)
    cold, warm = rows.join(known, "key", "left_anti"), rows.join(known, "key")
    left = warm.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    right = warm.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return meet(cold, cold, ["key"]).unionByName(meet(left, right, ["key", "cell"])).distinct()


def _copies(feats: DataFrame) -> DataFrame:
    """(rep, id): rows with the same words as the row with the least id among them."""
    groups = feats.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return cut_lineage(feats.select("h1", "h2", "id").join(groups, ["h1", "h2"]).where(F.col("id") != F.col("rep")).select("rep", "id").distinct())


def _verified(docs: DataFrame, feats: DataFrame, copies: DataFrame, threshold: float, exact: bool, split: Callable[[str], list[str]], run: int) -> DataFrame:
    """(a, b, similarity) of representatives, a < b."""
    near = candidate_pairs(feats.join(if_small(copies.select("id"), SMALL), "id", "left_anti"), threshold, exact)
    if not exact:
        sketches = if_small(feats.select("id", "nibbles"), SMALL // 8)
        near = near.join(sketches.toDF("a", "na"), "a").join(sketches.toDF("b", "nb"), "b").where(_equal_nibbles("na", "nb") >= nibbles_floor(threshold))
    near = cut_lineage(near.select("a", "b").distinct())
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    texts = docs.join(if_small(ids, SMALL), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    jaccard = F.pandas_udf(lambda a, b: pd.Series([_jaccard(x, y, split, run) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    return (
        near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", jaccard("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold)
    )


def _texts(pages: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return pages.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))


def near_duplicate_pairs(pages: DataFrame, threshold: float = 0.5, min_words: int = 80, id_column: str = "page_id", text_column: str = "text", exact: bool = False) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of texts with at least ``min_words`` words and a Jaccard
    similarity of ``threshold`` or more over sets of three consecutive words, as TESTDATA.md defines
    them: words are split at white space.

    Null, empty and shorter texts are in no pair; rows with a null id are left out. Texts with the
    same words are one representative until the end, so copies meet only in the result. Rows that
    repeat an id count once. With ``exact`` no candidate is tested on its sketch.
    """
    docs = _texts(pages, id_column, text_column)
    feats = cut_lineage(docs.where(F.length("text") >= 2 * min_words - 1).mapInPandas(_features(min_words), FEATURES))
    copies = _copies(feats)
    sure = _verified(docs, feats, copies, threshold, exact, split_words, RUN)
    if copies.isEmpty():
        return sure.toDF("id_a", "id_b", "similarity")
    sure = cut_lineage(sure)

    def spread(df: DataFrame, side: str) -> DataFrame:
        more = df.join(copies.select(F.col("rep").alias(side), F.col("id").alias("__id")), side).drop(side).withColumnRenamed("__id", side)
        return df.unionByName(more)

    members = copies.unionByName(copies.select("rep", F.col("rep").alias("id")).distinct())
    same = members.alias("x").join(members.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(
        F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), F.lit(1.0).alias("similarity"))
    wide = spread(spread(sure, "a"), "b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity")
    return wide.unionByName(same)


def components(links: DataFrame) -> DataFrame:
    """(id, class): the least id that each id of the links (a, b) is connected with.

    Each round takes the least label of all neighbours and then the label of that label, so rounds
    are about logarithmic in the longest chain. Every round is written down; nothing comes to the driver
    but the number of changes.
    """
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("class")))
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("class").alias("other")), "b").groupBy("a").agg(F.min("other").alias("least"))
        nearer = labels.join(near, "a").select("a", F.col("class").alias("old"), F.least("class", "least").alias("class"))
        jumped = nearer.join(labels.select(F.col("a").alias("class"), F.col("class").alias("root")), "class", "left")
        jumped = cut_lineage(jumped.select("a", "old", F.least("class", F.coalesce("root", "class")).alias("class")))
        changed = jumped.where(F.col("class") != F.col("old")).limit(1).count()
        labels = jumped.select("a", "class")
        if not changed:
            return labels.withColumnRenamed("a", "id")


def near_duplicate_groups(pages: DataFrame, threshold: float = 0.8, run: int = 5, id_column: str = "page_id", text_column: str = "text", exact: bool = False) -> DataFrame:
    """(id, class, links) of every text with a word: the least id of its group, and the number of different texts that it
    reaches ``threshold`` with, over sets of ``run`` consecutive words (characters where a script has no blanks).

    Copies share the class and the links of the least of them and are not paired. Texts of fewer than
    ``run`` words are grouped with their copies only. Null, empty and blank texts and rows with a null id are
    left out; rows that repeat an id count once.
    """
    docs = _texts(pages, id_column, text_column)
    feats = cut_lineage(docs.mapInPandas(_features(1, tokens), FEATURES))
    copies = _copies(feats)
    sure = cut_lineage(_verified(docs, feats, copies, threshold, exact, tokens, run))
    degree = sure.select(F.col("a").alias("id")).unionByName(sure.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    known = components(sure).join(degree, "id").withColumnRenamed("id", "rep")
    reps = feats.select("id").distinct().join(copies.select("id", "rep"), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return reps.join(known, "rep", "left").select("id", F.coalesce("class", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
