"""Test passages inside training text (problem 9).

Rare runs of words are the seeds. Of every LEAK consecutive words of a test item the run of SEED
words with the lowest document frequency in the corpus is one, so that no shared passage of LEAK
words is without a seed; a document that has one is aligned with the item. Copies with closer edits
share shorter runs: of every two runs of SHORT words the rarer is a seed as well, and a document
is aligned when three short seeds or more are together too rare for chance. The corpus is read once for all runs
of the items; Smith-Waterman alignment of words, weighted by their rarity, then decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.session import cut_lineage

LEAK = 12
SEED = 6
SHORT = 4
EVIDENCE = 10.0  # bits above log2 of the number of documents, so that chance brings an item 2**-10 documents
SEED_ROWS = 2_000_000  # runs of items that a pass over the corpus looks for; more make more passes
LOST = -0.6  # what a wrong or missing word of the item costs, as a share of its weight
ADDED = -2.0  # bits for a word that only the document has
SHIFT = 1 << 32
IDENTITY = 0.6  # least score of an alignment as a share of what an exact copy of the same words has
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


class _Known(dict):
    """Hashes of words met before; forgotten when there are many."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _hashes(w: list[str], known: _Known) -> np.ndarray:
    if len(known) > 1 << 20:
        known.clear()
    return np.array([known[x] for x in w], np.uint64)


def runs(h: np.ndarray, n: int = SEED) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words."""
    if len(h) < n:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        x = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)]
            x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


def align(item: list[str], doc: list[str], weight: dict[str, float] | None = None, usual: float = 6.0) -> tuple[int, float, int, float]:
    """(longest common stretch of words, score in bits, matched words, identity) of the best local alignment that copies LEAK words of the item.

    A matching word counts its weight, a wrong or missing one of the item LOST of it, one that only the
    document has ADDED. Identity is the score as a share of the weight of the item's words from the
    alignment's first to its last. Where no alignment has LEAK matches and IDENTITY these three are 0.
    """
    ids = {w: i for i, w in enumerate(dict.fromkeys(item))}
    y = np.array([ids.get(w, -1) for w in doc], np.int64)
    if not len(item) or not len(y):
        return 0, 0.0, 0, 0.0
    w = np.array([weight.get(x, usual) if weight else usual for x in item])
    total = np.concatenate([[0.0], np.cumsum(w)])
    places = np.arange(len(y) + 1)
    slope = -ADDED * places
    # where each path began and how many words match on it, in one number: began * SHIFT + matches
    row, path = np.zeros(len(y) + 1), np.zeros(len(y) + 1, np.int64)
    best, longest, stretch = (0.0, 0, 0.0), 0, np.zeros(len(y), np.int64)
    for i, x in enumerate(item):
        same = y == ids[x]
        alive = row.any()
        if not same.any():
            stretch[:] = 0
            if not alive:
                continue
        else:
            stretch[1:] = np.where(same[1:], stretch[:-1] + 1, 0)
            stretch[0] = same[0]
            exact = int(stretch.max())
            longest = max(longest, exact)
            if exact >= LEAK and (value := float(total[i + 1] - total[i + 1 - exact])) > best[0]:
                best = value, exact, 1.0
        diagonal, above = row[:-1] + np.where(same, w[i], LOST * w[i]), row + LOST * w[i]
        step = (np.where(row[:-1] > 0, path[:-1], i * SHIFT) if alive else i * SHIFT) + same
        new, came = above, path.copy()
        better = diagonal >= above[1:]
        np.copyto(new[1:], diagonal, where=better)
        np.copyto(came[1:], step, where=better)
        shifted = np.maximum(new, 0.0, out=new) + slope
        top = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == top, places, 0))  # gaps along the row
        row, path = top - slope, came[source]
        fit = np.flatnonzero(path % SHIFT >= LEAK)
        if len(fit):
            full = np.maximum(total[i + 1] - total[path[fit] // SHIFT], 1e-9)
            share = row[fit] / full
            k = int(np.argmax(np.where(share >= IDENTITY, row[fit], -1.0)))
            if share[k] >= IDENTITY and row[fit[k]] > best[0]:
                best = float(row[fit[k]]), int(path[fit[k]] % SHIFT), float(share[k])
    return longest, *best


def _item_runs(items: DataFrame) -> DataFrame:
    """(item_id, n, pos, seed): the runs of SEED and SHORT words and the single words of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known()
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["item_id"], pdf["text"], strict=True):
                h = _hashes(words(t), known)
                for n in (SEED, SHORT, 1):
                    r = h.view(np.int64) if n == 1 else runs(h, n)
                    rows.append((np.full(len(r), i, np.int64), np.full(len(r), n, np.int32), np.arange(len(r), dtype=np.int32), r))
            if rows:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("item_id", "n", "pos", "seed"), zip(*rows, strict=True), strict=True)})

    return items.mapInPandas(run, "item_id long, n int, pos int, seed long")


def _hits(docs: DataFrame, wanted) -> DataFrame:
    """(n, doc_id, seed, docs): which runs of ``wanted`` (a sorted array for each length) each document has. For single
    words only the number of a task's documents that have one, and for n = 0 the number of its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, want, seen = _Known(), wanted.value, 0
        totals = np.zeros(len(want[1]), np.int64)
        for pdf in batches:
            each = [_hashes(words(t), known) for t in pdf["text"]]
            ids = pdf["doc_id"].to_numpy(np.int64)
            seen += len(ids)
            lengths = np.array([len(h) for h in each])
            flat = np.concatenate(each) if each else np.empty(0, np.uint64)
            owner, left = np.repeat(np.arange(len(ids)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
            for n in (SEED, SHORT, 1):
                of = want[n]
                r = flat.view(np.int64) if n == 1 else runs(flat, n)
                if not len(of) or not len(r):
                    continue
                at = np.minimum(np.searchsorted(of, r), len(of) - 1)
                hit = np.flatnonzero((of[at] == r) & (left[: len(r)] >= n))
                pair = np.unique(owner[hit] * len(of) + at[hit])  # each run once a document
                if n == 1:
                    totals += np.bincount(pair % len(of), minlength=len(of))
                elif len(pair):
                    yield pd.DataFrame({"n": np.int32(n), "doc_id": ids[pair // len(of)], "seed": of[pair % len(of)], "docs": np.int64(1)})
        found = np.flatnonzero(totals)
        yield pd.DataFrame({"n": np.r_[np.ones(len(found), np.int32), np.zeros(1, np.int32)], "doc_id": np.int64(-1), "seed": np.r_[want[1][found], np.int64(0)], "docs": np.r_[totals[found], np.int64(seen)]})

    return docs.mapInPandas(run, "n int, doc_id long, seed long, docs long")


def rare_seeds(item_runs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(n, item_id, seed, docs): of every LEAK - SEED + 1 consecutive runs of SEED words of an item the one that fewest
    documents have, and of every two of SHORT words."""
    cols = item_runs.where(F.col("n") > 1).join(frequencies, ["n", "seed"], "left").select("item_id", "n", "pos", F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "seed").alias("run"))
    out = []
    for length, width in ((SEED, LEAK - SEED + 1), (SHORT, 2)):
        item = Window.partitionBy("item_id")
        at = cols.where(F.col("n") == length).withColumn("least", F.min("run").over(item.orderBy("pos").rowsBetween(0, width - 1))).withColumn("last", F.max("pos").over(item))
        out.append(at.where(F.col("pos") <= F.greatest(F.lit(0), F.col("last") - (width - 1))).select("n", "item_id", "least.seed", "least.docs").distinct())
    return out[0].unionByName(out[1])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run_words, score, matched, identity) of documents that copy LEAK words or more of an item,
    exactly or with edits, as the alignment decides.

    ``run_words`` is the longest common stretch of words; score, matched and identity are those of ``align``. Null
    texts and texts of fewer than SHORT words meet nothing. Rows that repeat an id are one document if
    their text is the same.
    """
    docs = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    sc = docs.sparkSession.sparkContext
    item_runs = cut_lineage(_item_runs(items).dropDuplicates())
    passes = max(1, -(-item_runs.count() // SEED_ROWS))
    hits = None
    for k in range(passes):
        part = item_runs.select("n", "seed").where(F.pmod("seed", F.lit(passes)) == k).distinct().toPandas()  # about SEED_ROWS at most
        wanted = sc.broadcast({n: np.sort(part.loc[part["n"] == n, "seed"].to_numpy(np.int64)) for n in (SEED, SHORT, 1)})
        found = _hits(docs, wanted)
        hits = found if hits is None else hits.unionByName(found)
    hits = cut_lineage(hits)
    counts = cut_lineage(hits.groupBy("n", "seed").agg(F.sum("docs").alias("docs")))  # at most as many rows as item_runs
    every = counts.where(F.col("n") == 0).agg(F.max("docs")).first()[0] or 0
    total = every // passes + 1
    seeds = cut_lineage(rare_seeds(item_runs, counts.where(F.col("n") > 1)))
    small = F.broadcast if passes == 1 else (lambda df: df)
    met = hits.where(F.col("n") > 1).select("n", "doc_id", "seed").join(small(seeds), ["n", "seed"])
    bits = F.sum(F.when(F.col("n") == SHORT, F.log2(F.lit(float(total)) / F.col("docs"))))
    pairs = met.groupBy("doc_id", "item_id").agg(F.bool_or(F.col("n") == SEED).alias("sure"), F.coalesce(bits, F.lit(0.0)).alias("bits"), F.count_if(F.col("n") == SHORT).alias("short"))
    pairs = pairs.where(F.col("sure") | ((F.col("bits") >= float(EVIDENCE + np.log2(total))) & (F.col("short") > 2))).select("doc_id", "item_id")
    # the weight of each word of an item travels with the item
    rarity = counts.where(F.col("n") == 1).select("seed", F.greatest(F.lit(0.5), F.log2(F.lit(float(total)) / F.col("docs"))).alias("weight"))
    known = item_runs.where(F.col("n") == 1).join(small(rarity), "seed", "left").groupBy("item_id").agg(F.map_from_entries(F.collect_set(F.struct("seed", F.coalesce("weight", F.lit(float(np.log2(total))))))).alias("weights"))
    asked = items.withColumnRenamed("text", "item_text").join(known, "item_id")
    both = pairs.join(docs.dropDuplicates(["doc_id", "text"]).withColumnRenamed("text", "doc_text"), "doc_id").join(asked, "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known()
        for pdf in batches:
            rows = []
            for d, i, a, b, w in zip(*(pdf[c] for c in ("doc_id", "item_id", "doc_text", "item_text", "weights")), strict=True):
                doc, item = words(a), words(b)
                by_hash = dict(w)
                weight = {x: by_hash[h] for x in set(item) if (h := int(np.uint64(known[x]).view(np.int64))) in by_hash}
                longest, score, matched, identity = align(item, doc, weight)
                if matched:
                    rows.append((d, i, longest, score, matched, identity))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_words", "score", "matched", "identity"])

    # alignments take long for the bytes that they read, so they are spread over all cores
    tasks = max(sc.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.select("doc_id", "item_id", "doc_text", "item_text", "weights").repartition(tasks).mapInPandas(verify, "doc_id long, item_id long, run_words int, score double, matched int, identity double")
