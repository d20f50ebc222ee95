"""Sentence units in many languages and scripts (problem 10).

Each paragraph is cut by semi-Markov dynamic programming: of all ways to divide it into spans at its
candidate points the one with the greatest sum of span scores is taken. A span's score joins how
likely its first word opens a unit, its last word and marks close one, its length, and whether the
quotes and brackets in it balance. What words and lengths are likely is counted over all documents,
in tables of fixed size, at places that leave no doubt: where paragraphs begin and end, and inside
clauses. Lists of abbreviations are only where those counts start from.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that don't end a sentence, without their last stop.
ABBREVIATIONS = frozenset(
    # English
    "dr mr mrs ms prof st vs cf fig figs no nos vol vols ch chap pp p approx e.g i.e sec ed eds rev gen col capt lt sgt hon gov sen rep jan feb mar apr jun jul aug sep sept oct nov dec mt ft viz resp dept est al "
    # German
    "hr fr nr bd s z z.b d d.h h ca bzw u.a usw. abs art str sog geb gest evtl ggf vgl aufl kap "
    # French, Spanish, Portuguese
    "m mm mme mlle mgr me env t chap p.ex ex av bd boul sr sra srta dra d dª núm pág págs cap aprox ee ee.uu ud uds av avda c art pto tel n.º nº séc fl fls cf "
    # Russian
    "см рис табл проф т т.е ок г-н г-жа ул д стр гл им св акад доц п пп руб тыс млн млрд напр "
    # Greek, Armenian, Hindi, Arabic
    "κ κα κος δρ περ π.χ π δηλ σελ αρ κεφ δοկ դոկտ պրոֆ डॉ श्री श्रीमती प्रो د أ م ص ا".split()
)
# Abbreviations that may also end one, when a capital follows.
FINAL = frozenset("etc a.m p.m inc ltd co corp jr usw ff u.s uu д.р др г гг т.д т.п п x χ κ.λπ κ.ά i.e".split()) - {"i.e"}
# Month names that follow an ordinal day with a stop.
ORDINAL_NEXT = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner jahrhundert".split())

CLOSERS = "”\"»’')]」』）】》›“］"
STRONG = "。！？｡।॥։።፧፨؟۔။༎‼⁇⁈"
SOFT = ".!?…;‥"
BULLET = re.compile(r"[*•·▪◦‣○●■–—-][ \t ]+|\(?\d{1,3}[.)][ \t ]+(?=\S)|[a-zA-Z][)][ \t ]+")
#: A stop between digits, or before a small letter or digit without a blank, is no candidate.
CANDIDATE = re.compile(rf"(?:[{STRONG}]|\.(?![a-z0-9,:/])|[.!?…‥]{{2,}}|[!?…‥]|(?<=[Ͱ-Ͽἀ-῿]);)[{SOFT}{STRONG}]*(?:[{re.escape(CLOSERS)}]|[   ][»›])*")
THAI_GAP = re.compile(r"(?<=[฀-๿຀-໿က-႟])[  ]+(?=[฀-๏຀-໿က-႟])")
PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "«": "»", "“": "”", "„": "“", "‹": "›", "［": "］", "‚": "‘"}
MARKED = re.compile('["' + re.escape("".join(dict.fromkeys([*PAIRS, *PAIRS.values()]))) + "]")
SAID = re.compile(r"[^。！？\n“”「」]{0,24}(?:问道|说道|说|写道|答道|回答|喊道|问)[。！？]")
PARTICLE = "とがをにはのもへでよねか"
WORD_BEFORE = re.compile(r"([^\s(\[{“„«»”「『\"—–/:;,]+)$")
#: The word that opens what follows; of scripts without blanks its first two characters.
OPENING = re.compile(r"\s*([—–-]?(?:[⺀-鿿가-힣]{1,2}|[^\W⺀-鿿가-힣][^\W⺀-鿿가-힣’']*)|\S|\Z)")
INNER = re.compile(r"(?<=[\w,] )(?:[⺀-鿿가-힣]{1,2}|[^\W⺀-鿿가-힣][^\W⺀-鿿가-힣’']*)")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
WINDOW = 40  # characters before a mark that hold its word, and of the line behind a break that hold its bullet
LONG_QUOTE = 800  # from this length on, a quotation counts for less the longer it is

SLOTS = 1 << 18
OPENS, INSIDE, CLOSES, GOES_ON, MIDDLE = range(5)
KINDS = 5
LENGTHS = 48  # two bins an octave, for scripts with and without blanks
SHORTEST = -4.0  # least score of a length: no cut below it pays, none above its double can be undone
PRIOR = 4.0  # observations that the starting values count for


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (SLOTS - 1)


def _bin(n: int) -> int:
    return min(LENGTHS // 2 - 1, int(2 * math.log2(max(n, 1))))


#: Bins of all lengths below that from which on they are alike.
_BINS = np.array([_bin(n) for n in range(int(2 ** ((LENGTHS // 2 - 1) / 2)) + 1)])


def _word_before(text: str, at: int, floor: int = 0) -> str:
    tail = WORD_BEFORE.search(text[max(floor, at - WINDOW) : at])
    return (tail[1] if tail else "").lstrip("'’‘*").lower()


class SpanModel:
    """Scores of opening words, closing words and lengths. Without counts the starting values alone decide."""

    def __init__(self, counts: np.ndarray | None = None, lengths: np.ndarray | None = None):
        self.counts, self.known_open, self.known_close = counts, {}, {}
        lengths = np.zeros(LENGTHS) if lengths is None else np.asarray(lengths, np.float64)
        self.length_table = []
        for half in (lengths[: LENGTHS // 2], lengths[LENGTHS // 2 :]):
            # a bin and its neighbours, so that few observations do; long spans have their starting values
            smooth = half + 0.5 * np.r_[0, half[:-1]] + 0.5 * np.r_[half[1:], 0]
            start = np.array([1.0 if b < 3 else 20.0 if 8 <= b <= 14 else 6.0 if b <= 17 else 1.0 for b in range(LENGTHS // 2)])
            share = (smooth + start * 5) / (smooth.sum() + 5 * start.sum())
            self.length_table.append(np.clip(0.5 * np.log(share / share.max()), SHORTEST, 0.0).tolist())

    def _n(self, kind: int, word: str) -> float:
        return float(self.counts[kind, _slot(word)]) if self.counts is not None else 0.0

    def opening(self, word: str) -> float:
        """Log odds that ``word`` opens a unit rather than stands inside one."""
        got = self.known_open.get(word)
        if got is None:
            c = word[:1]
            first = word[1:2] if c in "—–-" else c
            start = 0.0 if not c else 0.01 if first.islower() else 0.75 if first.isupper() else 0.35 if first.isdigit() else 0.03 if c in "—–-" and not first else 0.6
            a, b = self._n(OPENS, word), self._n(INSIDE, word) * 0.2  # units are about five words and more
            got = 0.0 if not c else math.log((a + PRIOR * start) / (b + PRIOR * (1 - start)))
            got = self.known_open[word] = min(max(got, -5.0), 4.0)
            if len(self.known_open) > 1 << 16:
                self.known_open.clear()
        return got

    def closing(self, word: str) -> float:
        """Log odds that a stop behind ``word`` ends a unit."""
        got = self.known_close.get(word)
        if got is None:
            start = 0.25 if word in FINAL else 0.01 if word in ABBREVIATIONS else 0.04 if len(word) == 1 and word.isalpha() else 0.1 if "." in word and word.replace(".", "").isalpha() else 0.5 if word.isdigit() and len(word) < 3 else 0.96
            end, on, mid = self._n(CLOSES, word), max(self._n(GOES_ON, word) - 1, 0.0), self._n(MIDDLE, word)  # one may be of the text at hand
            got = math.log((end + PRIOR * start) / (on + PRIOR * (1 - start)))
            # a word that ends units also ends paragraphs; one that is often before a capital and never there is short for something
            want = 0.1 * (mid + end)
            if want > 3 and end < 0.2 * want:
                got -= min(5.0, want - end)
            got = self.known_close[word] = min(max(got, -5.0), 4.0)
            if len(self.known_close) > 1 << 16:
                self.known_close.clear()
        return got

    def may_end(self, word: str) -> bool:
        """Is ``word`` known to end units though it also goes on?"""
        return word in FINAL or (word not in ABBREVIATIONS and self._n(CLOSES, word) >= PRIOR)

    def length(self, n: int, spaced: bool) -> float:
        return self.length_table[0 if spaced else 1][_bin(n)]

    @classmethod
    def fit(cls, docs: DataFrame) -> SpanModel:
        """Counts over all rows of ``docs`` (column text); KINDS * SLOTS + LENGTHS rows come back at most."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table, lengths, met = np.zeros((KINDS, SLOTS), np.int64), np.zeros(LENGTHS, np.int64), [Counter() for _ in range(KINDS)]

            def fold() -> None:
                for kind, words in enumerate(met):
                    for w, n in words.items():
                        table[kind, _slot(w)] += n
                    words.clear()

            for pdf in batches:
                for t in pdf["text"]:
                    if t:
                        observe(t, met, lengths)
                if sum(map(len, met)) > SLOTS:
                    fold()
            fold()
            kind, slot = np.nonzero(table)
            at = np.flatnonzero(lengths)
            yield pd.DataFrame({"kind": np.r_[kind, np.full(len(at), KINDS)].astype(np.int32), "slot": np.r_[slot, at].astype(np.int32), "n": np.r_[table[kind, slot], lengths[at]]})

        got = docs.select("text").mapInPandas(run, "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
        counts, lengths = np.zeros((KINDS, SLOTS), np.float32), np.zeros(LENGTHS)
        words = got[got["kind"] < KINDS]
        counts[words["kind"].to_numpy(), words["slot"].to_numpy()] = words["n"].to_numpy()
        rest = got[got["kind"] == KINDS]
        lengths[rest["slot"].to_numpy()] = rest["n"].to_numpy()
        return cls(counts, lengths)


def _spaced(text: str, at: int) -> bool:
    """Is what stands before ``at`` of a script with blanks between words?"""
    c = text[at - 1 : at]
    return not ("⺀" <= c <= "鿿" or "。" == c or "฀" <= c <= "႟" or "＀" <= c <= "￯")


def observe(text: str, met: list[Counter], lengths: np.ndarray) -> None:
    """Counts of one text at the places that leave no doubt."""
    met[INSIDE].update(INNER.findall(text))
    at = 0
    for gap in [*BLANK.finditer(text), None]:
        end = gap.start() if gap else len(text)
        word = OPENING.match(text, at)[1]
        if BULLET.match(text, at) is None and end - at > 1:
            met[OPENS][word] += 1
        at, start, marks, last = gap.end() if gap else end, at, 0, None
        for m in CANDIDATE.finditer(text, start, end):
            marks += 1
            last = m
            if m[0] == "." and m.end() < end and text[m.end()].isspace():
                nxt = text[m.end() + 1 : m.end() + 2]
                w = _word_before(text, m.start(), start)
                if nxt.isdigit() or (nxt.islower() and not word[:1].islower()):  # a text all in small letters shows nothing
                    met[GOES_ON][w] += 1
                elif nxt.isupper():
                    met[MIDDLE][w] += 1
        if last is not None and last.end() == end:
            if last[0] == ".":
                met[CLOSES][_word_before(text, last.start(), start)] += 1
            if marks == 1:
                lengths[_bin(end - start) + (0 if _spaced(text, last.start()) else LENGTHS // 2)] += 1


def _quotes(text: str, lo: int, hi: int) -> tuple[dict[int, float], set[int]]:
    """(where the weight of the quotes and brackets that are open changes, positions that close one). Those never closed don't count."""
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()
    change: dict[int, float] = {}
    closes: set[int] = set()

    def end(at: int, began: int) -> None:
        weight = min(1.0, LONG_QUOTE / max(at - began, 1))
        change[began] = change.get(began, 0.0) + weight
        change[at] = change.get(at, 0.0) - weight
        closes.add(at)

    for m in MARKED.finditer(text, lo, hi):
        c, i = m[0], m.start()
        if c == "“" and not waiting[c] or c != "“" and c in PAIRS:
            stack.append((PAIRS[c], i))
            waiting[PAIRS[c]] += 1
        elif c == '"' and not (stack and stack[-1][0] == c):
            stack.append((c, i))
            waiting[c] += 1
        elif waiting[c]:
            while True:
                want, began = stack.pop()
                waiting[want] -= 1
                if want == c:
                    end(i, began)
                    break
    return change, closes


def _cut(text: str, m: re.Match, stop: int, hi: int, model: SpanModel) -> float | None:
    """What spans that end with the marks of ``m`` and begin behind them gain; None where none does."""
    mark, at = text[m.start() : stop], m.start()
    opener = OPENING.match(text, stop, hi)
    word = opener[1]
    nxt = word[:1]
    if not nxt:
        return 0.0
    if nxt in ",;:，、；：)）]」』»”":
        return None
    gap = opener.start(1) > stop
    closed = mark[-1] in CLOSERS
    wide = nxt >= "⺀"
    if mark[0] in STRONG or any(c in STRONG for c in mark):
        if closed and (not gap and nxt in PARTICLE or SAID.match(text, opener.start(1), hi)):
            return None
        return 4.0 + model.opening(word) if nxt.islower() else 6.0 if not closed else 4.0 + max(model.opening(word), -2.0)
    core = mark.rstrip(CLOSERS + "   ")
    before = text[at - 1 : at]
    if not gap and not closed:
        if before >= "⺀" or wide:
            return 6.0 if core[0] in "!?…" or (core == "." and before >= "⺀" and wide) else None
        if core != "." or not nxt.isupper() or not (word[1:2].islower() or text[stop + 1 : stop + 2] == "."):
            return None
        last = _word_before(text, at)
        return model.closing(last) + model.opening(word) - 1.5 if last.isalpha() and len(last) > 1 else None
    if not gap:
        if wide:
            return 5.0 if core[:1] in "!?…" and not (nxt in PARTICLE or SAID.match(text, opener.start(1), hi)) else None
        return 1.0 if nxt.isupper() and core else None
    opens = model.opening(word)
    cased = nxt.isupper() or nxt.islower()
    if nxt.isupper():  # names stand inside units more often than they open one, but they do open some
        opens = max(opens, -1.0)
    if closed:
        return 2.5 + opens
    if core.startswith(("…", "..")):
        return 6.0 if before >= "⺀" and not nxt.islower() else (2.5 if nxt.isupper() else 1.5) + opens
    if core[:1] in "!?;" or core[-1:] in "!?":
        return 5.0 + opens if nxt.isupper() else 3.0 + opens if cased or not nxt.isalnum() else 7.0
    last = _word_before(text, at)
    if last.isdigit() and len(last) < 3 and word.lower() in ORDINAL_NEXT:
        return None
    closes = model.closing(last)
    if nxt.isupper() and model.may_end(last):
        closes = max(closes, 2.0)
    # behind a word that is short for nothing, what is all in small letters or without case opens as well
    return closes + (max(opens, -2.0) if cased or nxt.isalpha() else opens)


def _paragraph(text: str, lo: int, hi: int, model: SpanModel) -> Iterator[tuple[int, int]]:
    change, closes = _quotes(text, lo, hi)
    cuts: dict[int, float] = {}
    for m in CANDIDATE.finditer(text, lo, hi):
        stop = m.end()
        while stop > m.start() + 1 and text[stop - 1] in "“\"" and stop - 1 not in closes:
            stop -= 1  # it opens what follows
        if stop < hi and (score := _cut(text, m, stop, hi, model)) is not None:
            cuts[stop] = score
    for m in THAI_GAP.finditer(text, lo, hi):
        cuts[m.start()] = max(cuts.get(m.start(), 2.0), 2.0)
    forced = set()
    start = lo
    while (end := text.find("\n", start, hi)) >= 0:
        rest = text[end + 1 : min(hi, end + 1 + WINDOW)].lstrip(" \t ")
        listed, item, last = BULLET.match(rest), BULLET.match(text[start : start + WINDOW].lstrip()), text[start:end].rstrip()[-1:]
        if listed and not rest[:1].isdigit():
            forced.add(end)
        elif item:
            if not rest.lstrip()[:1].islower():
                forced.add(end)
        elif listed and last and last in SOFT + STRONG + ":":
            forced.add(end)
        elif end not in cuts and "฀" <= last <= "႟" and "฀" <= rest.lstrip()[:1] <= "႟":
            cuts[end] = 2.0
        start = end + 1
    # a span that opens or ends inside a quotation does not balance
    if change:
        marks, depth, k = sorted(change), 0.0, 0
        for p in sorted(cuts):
            while k < len(marks) and marks[k] < p:
                depth += change[marks[k]]
                k += 1
            if depth > 1e-9:
                cuts[p] -= 8.0 * depth
    yield from _divide(text, lo, hi, cuts, forced, model)


def _divide(text: str, lo: int, hi: int, cuts: dict[int, float], forced: set[int], model: SpanModel) -> Iterator[tuple[int, int]]:
    """The best spans. The sum changes by at most -2 * SHORTEST and at least SHORTEST with a cut, so scores beyond that are settled."""
    sure = -2 * SHORTEST
    points = sorted({hi, *forced, *(p for p, s in cuts.items() if s > SHORTEST or s >= sure)})
    start, open_points = lo, []
    for p in points:
        if p != hi and p not in forced and cuts[p] < sure:
            open_points.append(p)
            continue
        at = [start, *open_points, p]
        if len(at) > 2:
            at = _best(text, at, cuts, model)
        for a, b in zip(at, at[1:]):
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                yield a, b
        start, open_points = p, []


def _best(text: str, points: list[int], cuts: dict[int, float], model: SpanModel) -> list[int]:
    """The points of the division with the greatest sum. Spans past the table's last bin score alike, so one running maximum holds for them."""
    table = model.length_table[0 if _spaced(text, points[-1]) else 1]
    far, many = len(_BINS) - 1, len(points) > 64
    by_length, at = np.asarray(table)[_BINS], np.asarray(points)
    best, back = [0.0], [0]
    sums = np.zeros(len(points))
    tail, tail_at, k = float("-inf"), 0, 0  # the best of those further than ``far``
    for j in range(1, len(points)):
        p = points[j]
        while k < j and p - points[k] > far:
            if best[k] > tail:
                tail, tail_at = best[k], k
            k += 1
        top, arg = tail + table[-1], tail_at
        if many:
            near = sums[k:j] + by_length[p - at[k:j]]
            if near.size and near.max() > top:
                arg = k + int(near.argmax())
                top = float(near[arg - k])
        else:
            for i in range(k, j):
                score = best[i] + table[_bin(p - points[i])]
                if score > top:
                    top, arg = score, i
        best.append(top + cuts.get(p, 0.0) if j < len(points) - 1 else top)
        sums[j] = best[j]
        back.append(arg)
    chain, j = [points[-1]], len(points) - 1
    while j:
        j = back[j]
        chain.append(points[j])
    return chain[::-1]


def sentence_spans(text: str, model: SpanModel | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of ``text``, in code points, end exclusive.

    Empty and blank texts have none. A paragraph without any mark is one unit, however long.
    """
    model = model or SpanModel()
    out: list[tuple[int, int]] = []
    at = 0
    text = text.replace("\r", "\n") if "\r" in text else text
    for m in [*BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            out.extend(_paragraph(text, at, end, model))
        at = m.end() if m else end
    return out


def sentences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, model: SpanModel | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos[, sentence]) for every document; null texts have no units.

    ``model`` is fitted on ``docs`` where none is given. Repeated rows give repeated units; columns beside
    the two named ones are ignored.
    """
    rows = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    model = model or SpanModel.fit(rows)
    # KINDS * SLOTS floats, always
    sent = docs.sparkSession.sparkContext.broadcast((model.counts, model.length_table))
    schema = "doc_id long, start_pos long, end_pos long" + (", sentence string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = SpanModel(sent.value[0])
        at.length_table = sent.value[1]
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                if t:
                    rows += [(i, a, b, t[a:b]) if with_text else (i, a, b) for a, b in sentence_spans(t, at)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos"] + ["sentence"] * with_text)

    return rows.mapInPandas(run, schema)
