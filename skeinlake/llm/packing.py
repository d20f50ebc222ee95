"""Documents into containers of a fixed number of tokens by lexical retrieval (problem 8).

Documents fall into shards. A shard's BM25 inverted index scores, for the longest document still
unused, all unused documents of the shard as neighbours; they fill the container from the nearest on
while room for another of its size is left, and the neighbour that fills the rest best closes it.
Containers that stay underfull are opened again and packed in the same way in new shards, until that
no longer helps. No shard has many more than SHARD_DOCS documents in any round.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.session import cut_lineage

SHARD_DOCS = 2048
K1, B = 1.2, 0.75
WELL = 0.99  # containers below this fill are opened again
GAIN = 0.1  # share of the open documents that a round must settle for another to follow
TIGHT = 0.003  # room, as a share of the capacity, that a closing document may leave
LEFT = 0.5  # room, as a share of the capacity, that neighbours leave before the closing one is looked for
TERM = re.compile(r"[⺀-鿿가-힣]|[^\W⺀-鿿가-힣]+")
PARTS = "array<struct<target:int,part:int,parts:int,lo:long,hi:long,n:int>>"
ITEMS = f"doc_id long, terms array<int>, counts array<int>, parts {PARTS}"
PACKED = "target_id int, container_id string, doc_id long, part int, parts int, start_pos long, end_pos long, n_tokens int"


def load_tokenizer(path: str):
    """A tiktoken encoding of the rank file at ``path`` with the usual byte-level pattern."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def split_text(text: str, capacity: int, encoding) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of parts of a text above ``capacity``, each counted by itself.

    A part is filled up to the capacity; its cut falls behind white space where there is some in the last
    tenth of the part, else anywhere. A character of more tokens than the capacity is a part of its own.
    """
    count = lambda a, b: len(encoding.encode_ordinary(text[a:b]))
    offsets = encoding.decode_with_offsets(encoding.encode_ordinary(text))[1]
    out, at = [], 0
    while at < len(text):
        k = bisect_left(offsets, at) + capacity
        while True:
            end = offsets[k] if k < len(offsets) else len(text)
            if end < len(text):
                end = next((p for p in range(end, max(at + 1, end - (end - at) // 10), -1) if text[p - 1].isspace()), end)
            end = max(end, at + 1)
            n = count(at, end)
            if n <= capacity or end == at + 1:
                break
            k = min(k, len(offsets)) - max(1, n - capacity)  # cut off from the rest, the last token may become several
        out.append((at, end, n))
        at = end
    return out or [(0, 0, 0)]


def _items(vocabulary: str, targets: list[tuple[int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_tokenizer(vocabulary)
        hashes: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                n, parts = len(encoding.encode_ordinary(t)), []
                for target, capacity in targets:
                    cuts = [(0, len(t), n)] if n <= capacity else split_text(t, capacity, encoding)
                    parts += [{"target": target, "part": k, "parts": len(cuts), "lo": a, "hi": b, "n": c} for k, (a, b, c) in enumerate(cuts)]
                terms: Counter = Counter()
                for w, k in Counter(TERM.findall(t.lower())).items():
                    h = hashes.get(w)
                    if h is None:
                        h = hashes[w] = xxhash.xxh32_intdigest(w) & 0x7FFFFFFF
                    terms[h] += k
                rows.append((i, list(terms), list(terms.values()), parts))
            if len(hashes) > 1 << 20:
                hashes.clear()
            yield pd.DataFrame(rows, columns=["doc_id", "terms", "counts", "parts"])

    return run


class BM25:
    """An inverted index over the documents of a shard: their terms and how often each has them."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        self.n = len(terms)
        lengths = np.array([len(t) for t in terms], np.int64)
        sizes = np.array([c.sum() for c in counts], np.float64)
        flat, often = np.concatenate([*terms, np.empty(0, np.int64)]), np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.float64)
        order = np.argsort(flat, kind="stable")
        self.docs = np.repeat(np.arange(self.n), lengths)[order]
        flat, often = flat[order], often[order]
        words, start, at = np.unique(flat, return_index=True, return_inverse=True)
        self.start, self.end = start, np.append(start[1:], len(flat))
        df = self.end - start
        norm = K1 * (1 - B + B * sizes / max(sizes.mean() if self.n else 1.0, 1e-9))
        self.weight = np.log(1 + (self.n - df + 0.5) / (df + 0.5))[at] * often * (K1 + 1) / (often + norm[self.docs])
        self.of = np.split(np.searchsorted(words, np.concatenate([*terms, np.empty(0, np.int64)])), np.cumsum(lengths)[:-1]) if self.n else []

    def scores(self, doc: int) -> np.ndarray:
        """BM25 score of every document against all terms of ``doc``."""
        score = np.zeros(self.n)
        for k in self.of[doc].tolist():
            a, b = self.start[k], self.end[k]
            score[self.docs[a:b]] += self.weight[a:b]
        return score


def fill(sizes: np.ndarray, owner: np.ndarray, capacity: int, index: BM25) -> list[list[int]]:
    """Containers of item numbers, none above ``capacity``; ``owner`` is each item's document in ``index``."""
    unused = np.ones(len(sizes), bool)
    by_size = np.argsort(-sizes, kind="stable")
    out = []
    for seed in by_size.tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        box, room = [seed], capacity - int(sizes[seed])
        left = np.flatnonzero(unused & (sizes <= room))
        if room > 0 and len(left):
            score = index.scores(owner[seed])[owner[left]]
            near = left[np.argsort(-score, kind="stable")]
            related = int((score > 0).sum())
            size, at = sizes[near], 0

            def take(k: int) -> None:
                nonlocal room
                unused[near[k]] = False
                box.append(int(near[k]))
                room -= int(size[k])
                size[k] = capacity + 1  # fits no more

            while at < related and len(k := np.flatnonzero(size[at:related] <= room - LEFT * capacity)):
                at += int(k[0])
                take(at)
            # closing: the nearest of those that fill the room, else the longest; neighbours first
            for group in (slice(0, related), slice(related, len(near))):
                while room > 0 and len(k := np.flatnonzero(size[group] <= room)):
                    k += group.start
                    tight = k[size[k] >= room - TIGHT * capacity]
                    take(int(tight[0]) if len(tight) else int(k[np.argmax(size[k])]))
        out.append(box)
    return out


def _pack(label: str, capacities: dict[int, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row"], kind="stable").reset_index(drop=True)
        rows = []
        shard = int(pdf["shard"].iloc[0])
        index = BM25([np.asarray(t, np.int64) for t in pdf["terms"]], [np.asarray(c, np.int64) for c in pdf["counts"]])
        for target, capacity in capacities.items():
            items = [(k, p) for k, parts in enumerate(pdf["parts"]) for p in parts if p["target"] == target]
            if not items:
                continue
            sizes, owner = np.array([p["n"] for _, p in items], np.int64), np.array([k for k, _ in items], np.int64)
            for c, box in enumerate(fill(sizes, owner, capacity, index)):
                name = f"{target}-{label}{shard}-{c}"
                rows += [(target, name, int(pdf["doc_id"].iloc[items[i][0]]), items[i][1]["part"], items[i][1]["parts"], items[i][1]["lo"], items[i][1]["hi"], items[i][1]["n"], int(pdf["row"].iloc[items[i][0]])) for i in box]
        return pd.DataFrame(rows, columns=["target_id", "container_id", "doc_id", "part", "parts", "start_pos", "end_pos", "n_tokens", "row"])

    return run


def pack(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(target_id, container_id, doc_id, part, parts, start_pos, end_pos, n_tokens): where each document, or part of
    one, goes for each capacity.

    Only texts above the capacity have parts, which join to the whole text. Null texts are left out,
    empty ones take no room. Rows that repeat an id are packed as often. Targets without a capacity
    above zero are left out; the targets are few and come to the driver.
    """
    capacities = {r["target_id"]: r["capacity"] for r in targets.where(F.col("capacity") > 0).select("target_id", "capacity").collect()}
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = cut_lineage(rows.mapInPandas(_items(vocabulary or default_vocabulary(), list(capacities.items())), ITEMS).withColumn("row", F.monotonically_increasing_id()))
    packed_as = PACKED + ", row long"
    shards = max(1, -(-items.count() // SHARD_DOCS))
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    packed = cut_lineage(sharded.groupBy("shard").applyInPandas(_pack("s", capacities), packed_as))
    done, level, before = [], 0, None
    capacity = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv]) if capacities else None
    while capacity is not None and shards > 1:
        level += 1
        full = packed.groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("used")).withColumn("full", F.col("used") >= WELL * capacity[F.col("target_id")]).drop("used")
        judged = cut_lineage(packed.join(full, ["target_id", "container_id"]))
        loose = judged.where(~F.col("full"))
        part = F.struct(F.col("target_id").alias("target"), "part", "parts", F.col("start_pos").alias("lo"), F.col("end_pos").alias("hi"), F.col("n_tokens").alias("n"))
        again = loose.select("row", part.alias("p")).groupBy("row").agg(F.collect_list("p").alias("parts"))  # the parts of one text
        left = loose.count()
        if left == 0 or (before is not None and left > (1 - GAIN) * before):
            packed = judged.drop("full")
            break
        before, shards = left, max(1, -(-again.count() // SHARD_DOCS))
        done.append(judged.where("full").drop("full"))
        again = again.join(items.drop("parts"), "row").withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)).cast("int"))
        packed = cut_lineage(again.groupBy("shard").applyInPandas(_pack(f"r{level}.", capacities), packed_as))
    out = packed
    for d in done:
        out = out.unionByName(d)
    return out.drop("row")
