"""Main body and boilerplate of web pages by wrapper induction (problem 7).

Hosts go by a 64-bit hash. A page is a tree: its lines are the nodes below the root, the parts of a menu line the nodes below
that. Trees of pages of the same host are aligned in pairs by simple tree matching; nodes that
match are constant and become the host's template, nodes that vary are content, except in the
slots of a template's link lists. What is constant on many hosts needs no pages of its own host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.llm.garble import STARTS, plain_restore, suspect
from skeinlake.session import cut_lineage

PARTS = re.compile(r"\s+[·|/>»›•]\s+|\s*[|｜]\s*")
SEPARATOR = re.compile(r"[·|/>»›•｜]")
DIGITS = re.compile(r"\d\d*")  # as \d+, but searched for as a single character
HOLDER = re.compile(r"(©|\(c\)|copyright)\s*0\s+[^\s.,]+")
TREE = "page_id long, host long, line_nos array<int>, sigs array<long>, skeletons array<long>, kinds array<int>, parts array<array<long>>, lens array<int>"
TITLE, SENTENCE, CRUMB, LONG = 1, 2, 4, 8
NAME = re.compile(r"[A-Z][a-z'’]{2,}")
PLAIN = re.compile(r"[^\W\dA-Z_][^\W\d_]+|[぀-ヿ㐀-鿿]{2}")
END = re.compile(r"[.!。！…][”\"»’)\]」』]*$")
INSIDE = re.compile(r"[.!?]\s+\S|[。！？]")

MANY_HOSTS = 12  # hosts that make a menu part known everywhere
CHUNK_PAGES = 128
PARTNERS = 4  # pages that a page is aligned with, to confirm the order of what all pages are counted for
COPIED = 0.2  # share of a page's text that makes it a copy of another
MODEL_ROWS = 2_000_000  # rows of 16 bytes that may be broadcast


def signature(s: str, site: str) -> str:
    """A line, given without case and numbers, without what else differs between pages of one template: the site's name, the holder of rights."""
    if len(site) > 3:
        s = s.replace(site, "*")
    return HOLDER.sub(r"\1 0 *", s) if "©" in s or "(c)" in s or "copyright" in s else s


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def skeleton(line: str, s: str) -> str | None:
    """A line, given also without its names and numbers, in that form, but with its first word where little else is left; None where nothing is."""
    if (one := PLAIN.search(s)) and PLAIN.search(s, one.end()):
        return s
    head, rest = line.partition(" ")[0], s.partition(" ")[2]
    s = head + " " + rest
    return s if rest and (PLAIN.search(s[len(head) :]) or " | " in s or " · " in s) else None


def line_kind(line: str) -> int:
    if len(line) > 100:
        return SENTENCE | LONG
    return SENTENCE if END.search(line) or INSIDE.search(line) else TITLE


def page_tree(text: str, site: str) -> tuple[list[int], list[int], list[int], list[int], list[list[int]], list[int]]:
    """(line numbers, signatures, skeletons, kinds, parts, lengths) of the non-empty lines; the length is 0 where a signature is repeated."""
    if not text.isascii() and STARTS.search(text) and suspect(text):
        fixed = plain_restore(text)
        if fixed is not None and fixed.count("\n") == text.count("\n"):
            text = fixed
    nos, sigs, skeletons, kinds, parts, lens, met = [], [], [], [], [], [], set()
    # names and numbers don't cross lines, so the whole text is rid of them at once; none of it makes or takes a blank
    plain = DIGITS.sub("0", text)
    for n, (line, folded, bare) in enumerate(zip(text.split("\n"), plain.casefold().split("\n"), NAME.sub("*", plain).split("\n"), strict=True), 1):
        line = line.strip()
        if not line:
            continue
        folded, bare = folded.strip(), skeleton(line, bare.strip())
        kind = line_kind(line)
        own: list[int] = []
        if SEPARATOR.search(line) and (not kind & LONG or line.count(" · ") + line.count(" | ") + line.count(" / ") > 3):
            pieces = PARTS.split(folded)
            if len(pieces) > 1:
                own = [_hash(signature(p, site)) for p in pieces]
                if len(pieces) == 2:
                    kind |= CRUMB
        nos.append(n)
        sigs.append(_hash(signature(folded, site)))
        skeletons.append(0 if bare is None else _hash(bare))
        kinds.append(kind)
        parts.append(own)
        lens.append(0 if sigs[-1] in met else len(line))
        met.add(sigs[-1])
    return nos, sigs, skeletons, kinds, parts, lens


def simple_tree_matching(a: list[tuple[int, list]], b: list[tuple[int, list]]) -> tuple[int, list[tuple[int, int]]]:
    """(size of the largest order-preserving match of two forests, matched pairs of their roots).

    Nodes match when their labels do; then their children are matched in the same way.
    """
    common = {x for x, _ in a} & {x for x, _ in b}
    if not common:
        return 0, []
    ia, ib = [i for i, (x, _) in enumerate(a) if x in common], [j for j, (x, _) in enumerate(b) if x in common]
    best = [[0] * (len(ib) + 1) for _ in range(len(ia) + 1)]
    for i, p in enumerate(ia, 1):
        row, above = best[i], best[i - 1]
        label, children = a[p]
        for j, q in enumerate(ib, 1):
            w = above[j] if above[j] > row[j - 1] else row[j - 1]
            if b[q][0] == label:
                inner = 1 + (simple_tree_matching(children, b[q][1])[0] if children and b[q][1] else 0)
                w = max(w, above[j - 1] + inner)
            row[j] = w
    pairs, i, j = [], len(ia), len(ib)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((ia[i - 1], ib[j - 1]))
            i, j = i - 1, j - 1
    return best[-1][-1], pairs[::-1]


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, host, text in zip(pdf["page_id"], pdf["host"], pdf["text"], strict=True):
            labels = (host or "").split(".")
            rows.append((i, _hash(host or ""), *page_tree(text, labels[-2] if len(labels) > 1 else "")))
        yield pd.DataFrame(rows, columns=["page_id", "host", "line_nos", "sigs", "skeletons", "kinds", "parts", "lens"])


def _align(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the aligned pairs of one chunk of a host's pages, how many have a line on both pages and how many match it.

    Pairs of the same class are copies of each other, whose body would look constant; they are left out.
    """
    pdf = pdf.sort_values("order")
    forests = [[(s, [(int(x), []) for x in p]) for s, p in zip(sigs.tolist(), parts, strict=True)] for sigs, parts in zip(pdf["sigs"], pdf["parts"], strict=True)]
    labels = [{s for s, _ in x} for x in forests]
    of = pdf["class"].tolist()
    met: Counter = Counter()
    matched: Counter = Counter()
    for i, x in enumerate(forests):
        for j in range(i + 1, min(i + 1 + PARTNERS, len(forests))):
            if of[i] != of[j]:
                met.update(labels[i] & labels[j])
                matched.update({x[p][0] for p, _ in simple_tree_matching(x, forests[j])[1]})
    return pd.DataFrame({"host": pdf["host"].iloc[0], "sig": np.array(list(met), np.int64), "met": np.array(list(met.values()), np.int64), "matched": np.array([matched[s] for s in met], np.int64)})


def page_trees(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", text_column: str = "text") -> DataFrame:
    host = F.regexp_replace(F.lower(F.regexp_extract(F.col(url_column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")
    rows = pages.where(F.col(text_column).isNotNull() & (F.col(text_column) != "") & F.col(id_column).isNotNull())
    return rows.select(F.col(id_column).cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.col(text_column).alias("text")).mapInPandas(_trees, TREE)


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """The least page of the connected component of each page of a host's copies."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for a, b in zip(pdf["page_id"].tolist(), pdf["first"].tolist(), strict=True):
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return pd.DataFrame({"host": pdf["host"].iloc[0], "page_id": np.array(list(up), np.int64), "class": np.array([root(x) for x in up], np.int64)})


def copy_classes(trees: DataFrame) -> DataFrame:
    """(host, page_id, class) of pages that share COPIED of the shorter one's text with another page of their host, and of pages
    that are so linked through others. A shared line counts the less the more of the host's pages have it, so that
    what all pages have makes no copies.

    Each line links its pages to the least of them, so links are no more than lines.
    """
    sizes = trees.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    whole = F.aggregate("lens", F.lit(0), lambda x, y: x + y)
    rows = trees.select("host", "page_id", F.monotonically_increasing_id().alias("row"), whole.alias("whole"), F.arrays_zip("sigs", "lens").alias("z")).join(sizes, "host")
    nodes = rows.select("host", "n", "page_id", "row", "whole", F.explode("z").alias("z")).select("host", "n", "page_id", "row", "whole", F.col("z.sigs").alias("sig"), F.col("z.lens").alias("len")).where(F.col("len") > 0)
    line = Window.partitionBy("sig", "host")
    shared = nodes.withColumn("on", F.count(F.lit(1)).over(line)).withColumn("first", F.min(F.struct("page_id", "whole")).over(line)).where((F.col("on") > 1) & (F.col("page_id") != F.col("first.page_id")))
    weight = F.least(F.lit(1.0), 1 - F.col("on") / F.col("n") + 1 / F.col("on"))
    links = shared.groupBy("host", "page_id", "row", "whole", "first").agg(F.sum(F.col("len") * weight).alias("same"))
    links = links.where(F.col("same") >= COPIED * F.least("whole", "first.whole")).select("host", "page_id", F.col("first.page_id").alias("first"))
    return links.groupBy("host").applyInPandas(_components, "host long, page_id long, class long")


def host_templates(trees: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, sig) of constant nodes: those on pages of three classes of the host, and for lines that read as sentences on
    one class for each fifty pages, because such lines are also copied alone. Every page counts; copies count once.
    Parts count in menu lines that stand on more than one page.

    Alignment confirms the order: a line that aligned pages hold but mostly don't match is not constant.
    """
    sizes = trees.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    order = F.xxhash64("page_id", F.lit(17))
    trees = trees.join(sizes, "host").join(classes, ["host", "page_id"], "left").withColumn("class", F.coalesce("class", "page_id"))
    chunked = trees.select("host", F.pmod(F.xxhash64("page_id"), F.ceil(F.col("n") / CHUNK_PAGES)).alias("chunk"), order.alias("order"), "class", "sigs", "parts")
    met = chunked.groupBy("host", "chunk").applyInPandas(_align, "host long, sig long, met long, matched long").groupBy("host", "sig").agg(F.sum("met").alias("met"), F.sum("matched").alias("matched"))
    disordered = met.where(2 * F.col("matched") < F.col("met")).select("host", "sig")
    lines = trees.select("host", "class", F.explode(F.arrays_zip("sigs", "kinds")).alias("z")).select("host", "class", F.col("z.sigs").alias("sig"), (F.col("z.kinds").bitwiseAND(SENTENCE) > 0).alias("reads"))
    menus = trees.select("host", "class", "page_id", F.explode(F.filter(F.arrays_zip("sigs", "parts"), lambda z: F.size(z["parts"]) > 2)).alias("z")).select("host", "class", "page_id", F.col("z.sigs").alias("line"), F.col("z.parts").alias("p"))
    repeated = menus.groupBy("host", "line").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).where(F.col("a") < F.col("b")).select("host", "line")
    parts = menus.join(repeated, ["host", "line"]).select("host", "class", F.explode("p").alias("sig"), F.lit(False).alias("reads"))
    counted = lines.unionByName(parts).groupBy("host", "sig", "class").agg(F.max("reads").alias("reads")).groupBy("host", "sig").agg(F.count(F.lit(1)).alias("classes"), F.max("reads").alias("reads"))
    enough = F.when(F.col("reads"), F.greatest(F.lit(3), F.col("n") / 50)).otherwise(3)
    return counted.where(F.col("classes") > 2).join(sizes, "host").where(F.col("classes") >= enough).join(disordered, ["host", "sig"], "left_anti").select("host", "sig")


def common_nodes(trees: DataFrame, templates: DataFrame) -> DataFrame:
    """(what, sig) of nodes that need no template of their own host: lines (what 0) that a tenth of
    the hosts have, or that are constant on three hosts and one of twenty that have them, skeletons (what 2) that are so on three hosts and one of ten lines, and
    menu parts (what 1) on MANY_HOSTS hosts. Lines that read as sentences need three of twenty constant."""
    nodes = trees.select("host", F.explode(F.arrays_zip("sigs", "skeletons", "kinds")).alias("z"))
    nodes = nodes.select("host", F.col("z.sigs").alias("sig"), F.col("z.skeletons").alias("skeleton"), F.col("z.kinds").bitwiseAND(SENTENCE).alias("sentence")).distinct()
    nodes = nodes.join(templates.withColumn("fixed", F.lit(1)), ["host", "sig"], "left")
    lines = nodes.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.count("fixed").alias("fixed"), F.max("sentence").alias("sentence"))
    hosts = trees.select(F.count_distinct("host").alias("all_hosts"))
    often = F.col("n") >= F.greatest(F.lit(MANY_HOSTS), 0.1 * F.col("all_hosts"))
    lines = lines.crossJoin(F.broadcast(hosts)).where(
        F.when(F.col("sentence") == 0, often | ((F.col("fixed") >= 3) & (F.col("fixed") >= 0.05 * F.col("n")))).otherwise((F.col("fixed") >= 3) & (F.col("fixed") >= 0.15 * F.col("n")))).select(F.lit(0).alias("what"), "sig")
    bare = nodes.where(F.col("skeleton") != 0).groupBy("skeleton").agg(F.count(F.lit(1)).alias("n"), F.count("fixed").alias("fixed"), F.count_distinct(F.when(F.col("fixed") == 1, F.col("host"))).alias("hosts"))
    bare = bare.where((F.col("hosts") >= 3) & (F.col("fixed") >= 0.1 * F.col("n"))).select(F.lit(2).alias("what"), F.col("skeleton").alias("sig"))
    parts = trees.select("host", F.explode(F.filter("parts", lambda p: F.size(p) > 2)).alias("p")).select("host", F.explode("p").alias("sig")).distinct()
    parts = parts.groupBy("sig").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= MANY_HOSTS).select(F.lit(1).alias("what"), "sig")
    return lines.unionByName(bare).unionByName(parts)


class Wrapper:
    """Decides the lines of a page, given the templates of hosts and the nodes common to many."""

    def __init__(self, templates: dict[str, set[int]], lines: set[int], parts: set[int], bare: set[int], heads: frozenset[int] = frozenset()):
        self.templates, self.lines, self.parts, self.bare, self.heads = templates, lines, parts, bare, heads

    def constant(self, host: str, sigs: list[int], skeletons: list[int], kinds: list[int], parts: list[list[int]]) -> list[bool]:
        own = self.templates.get(host, ())
        out = []
        for s, b, k, p in zip(sigs, skeletons, kinds, parts, strict=True):
            known = s in own or s in self.lines or b in self.bare or (s in self.parts and not k & SENTENCE)
            if not known and len(p) > 2:
                known = sum(x in self.parts or x in own for x in p) >= 0.75 * len(p)
            if not known and k & CRUMB and len(p) == 2:
                known = (p[0] in self.parts or p[0] in own or p[0] in self.lines) and not k & SENTENCE
            out.append(known)
        return out

    def slots(self, kinds: list[int], constant: list[bool], at: int) -> int:
        """Varying title-like lines right behind the node at ``at``."""
        n = 0
        while at + 1 + n < len(kinds) and not constant[at + 1 + n] and not kinds[at + 1 + n] & SENTENCE:
            n += 1
        return n

    def boilerplate(self, host: str, sigs: list[int], skeletons: list[int], kinds: list[int], parts: list[list[int]]) -> list[bool]:
        constant = self.constant(host, sigs, skeletons, kinds, parts)
        out = list(constant)
        for i, s in enumerate(sigs):
            if constant[i] and s in self.heads:
                for j in range(self.slots(kinds, constant, i)):
                    out[i + 1 + j] = True
        return out


def _plain(pdf: pd.DataFrame) -> Iterator[tuple]:
    for i, host, nos, sigs, skeletons, kinds, parts in zip(*(pdf[c] for c in ("page_id", "host", "line_nos", "sigs", "skeletons", "kinds", "parts")), strict=True):
        yield i, host, nos.tolist(), sigs.tolist(), skeletons.tolist(), kinds.tolist(), [p.tolist() for p in parts]


KNOWN = ("own", "lines", "parts_known", "bare", "heads")


def _with_own(wrapper: Wrapper, pdf: pd.DataFrame) -> Iterator[tuple]:
    """_plain, with the known nodes that travel with a page put into the wrapper where they do."""
    sets = {c: pdf[c] for c in KNOWN if c in pdf}
    for k, row in enumerate(_plain(pdf)):
        if sets:
            own, wrapper.lines, wrapper.parts, wrapper.bare, wrapper.heads = (set() if c not in sets or sets[c].iloc[k] is None else set(sets[c].iloc[k].tolist()) for c in KNOWN)
            wrapper.templates = {row[1]: own}
        yield row


def list_heads(trees: DataFrame, model) -> DataFrame:
    """(sig) of constant nodes that mostly have varying titles behind them; such a list ends at the first sentence or constant node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wrapper, seen = Wrapper(*model.value), Counter()
        for pdf in batches:
            for _, host, _, sigs, skeletons, kinds, parts in _with_own(wrapper, pdf):
                constant = wrapper.constant(host, sigs, skeletons, kinds, parts)
                for i, s in enumerate(sigs):
                    if constant[i] and (s in wrapper.lines or skeletons[i] in wrapper.bare) and i + 1 < len(sigs):
                        seen[s, min(wrapper.slots(kinds, constant, i), 1)] += 1
        yield pd.DataFrame({"sig": np.array([s for s, _ in seen], np.int64), "slots": np.array([n for _, n in seen], np.int32), "n": np.array(list(seen.values()), np.int64)})

    got = trees.mapInPandas(run, "sig long, slots int, n long").groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("slots")).alias("filled"))
    return got.where((F.col("n") >= 5) & (F.col("filled") >= 0.6 * F.col("n"))).select("sig")


def _marked(trees: DataFrame, known: dict[str, tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """``trees`` with, for each name of ``known``, the nodes of the page that are in a table: (kind of node, table, columns
    to join on). Nodes meet the table on its own columns, so what moves is nodes, never a template for each page."""
    out = trees
    for name, (nodes, table, on) in known.items():
        at = trees.select("row", "host", F.explode(F.array_distinct(F.expr(nodes))).alias("sig")).join(table, on)
        out = out.join(at.groupBy("row").agg(F.collect_set("sig").alias(name)), "row", "left")
    return out


def boilerplate_lines(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", text_column: str = "text") -> DataFrame:
    """(page_id, line_no) of non-empty lines that are not main body; the first line is 1.

    Null and empty texts have no lines. Pages whose url has no host are one host of their own.
    Each row is a page, so rows with the same id give the same lines twice. What is known of hosts is
    broadcast up to MODEL_ROWS rows; beyond, pages are joined with it.
    """
    trees = cut_lineage(page_trees(pages, id_column, url_column, text_column).withColumn("row", F.monotonically_increasing_id()))
    templates = cut_lineage(host_templates(trees, cut_lineage(copy_classes(trees))))
    common = cut_lineage(common_nodes(trees, templates))
    sc = pages.sparkSession.sparkContext
    kind = lambda k: common.where(F.col("what") == k).select("sig")
    if templates.limit(MODEL_ROWS + 1).count() + common.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS:
        known: dict[str, set[int]] = {}
        for h, s in zip(*(c for _, c in templates.toPandas().items()), strict=True):
            known.setdefault(h, set()).add(int(s))
        got = common.toPandas()
        lines, parts, bare = (set(got.loc[got["what"] == k, "sig"].astype("int64").tolist()) for k in (0, 1, 2))
        joined = trees
        heads = frozenset(r["sig"] for r in list_heads(joined, sc.broadcast((known, lines, parts, bare))).collect())  # no more than ``lines``
        model = sc.broadcast((known, lines, parts, bare, heads))
    else:
        every = "concat(sigs, flatten(parts))"
        joined = cut_lineage(_marked(trees, {"own": (every, templates, ["host", "sig"]), "lines": (every, kind(0), ["sig"]), "parts_known": (every, kind(1), ["sig"]), "bare": ("skeletons", kind(2), ["sig"])}))
        joined = _marked(joined, {"heads": ("sigs", cut_lineage(list_heads(joined, sc.broadcast(({}, set(), set(), set())))), ["sig"])})
        model = sc.broadcast(({}, set(), set(), set(), frozenset()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wrapper = Wrapper(*model.value)
        for pdf in batches:
            ids, nos_out = [], []
            for i, host, nos, sigs, skeletons, kinds, own_parts in _with_own(wrapper, pdf):
                for n, b in zip(nos, wrapper.boilerplate(host, sigs, skeletons, kinds, own_parts), strict=True):
                    if b:
                        ids.append(i)
                        nos_out.append(n)
            yield pd.DataFrame({"page_id": np.array(ids, np.int64), "line_no": np.array(nos_out, np.int64)})

    return joined.mapInPandas(run, "page_id long, line_no long")


def main_body(pages: DataFrame, id_column: str = "page_id", text_column: str = "text", **kw: str) -> DataFrame:
    """(page_id, body): the lines that are not boilerplate, in order; null where text is null."""
    cut = boilerplate_lines(pages, id_column=id_column, text_column=text_column, **kw).distinct().groupBy("page_id").agg(F.collect_set("line_no").alias("cut"))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(text_column).alias("text")).join(cut, "page_id", "left")
    kept = F.expr("filter(split(text, '\\n'), (l, i) -> NOT array_contains(coalesce(cut, array()), cast(i + 1 as bigint)))")
    return rows.select("page_id", F.array_join(kept, "\n").alias("body"))
