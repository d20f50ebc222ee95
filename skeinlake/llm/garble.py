"""Text decoded with the wrong encoding (problem 5).

Adjacent characters are scored by their mutual information in the clean part of the corpus,
stretches of improbable pairs are isolated as maximum-scoring segments, and inverse mappings are
tried only inside the runs around them. The statistics are a table of fixed size, so what is sent
to the executors doesn't grow with the data.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_SLOTS = 1 << 21  # one byte each
CHAR_SLOTS = 1 << 16  # four bytes each

#: Encodings whose reading of UTF-8 bytes is undone, in order of preference. "cp1252*" and the
#: like keep undefined bytes as C1 controls.
READINGS = ("cp1252", "latin_1", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866")
#: Encodings of East Asian bytes that were read as Latin.
EAST = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")


def _byte_map(encoding: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_TO_BYTE = {e: {ord(c): b for b, c in reversed(list(enumerate(_byte_map(e))))} for e in READINGS}
for _t in _TO_BYTE.values():
    for _b in range(0x80, 0xA0):
        _t.setdefault(_b, _b)


def _class(encoding: str, lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c in _byte_map(encoding)[lo : hi + 1]) + "]"


def _sequence(encoding: str, leads: str | None = None) -> str:
    low, high, tail = _class(encoding, 0xC2, 0xDF), _class(encoding, 0xE0, 0xEF), _class(encoding, 0x80, 0xBF)
    return f"{leads or low}{tail}" if leads else f"{low}{tail}|{high}{tail}{{2}}"


#: Fields that stay out of the statistics: with a multi-byte UTF-8 sequence as each encoding shows it, C1 controls,
#: U+FFFD, four Latin high characters in a row, East Asian lead bytes as cp1252 shows them, Cyrillic case turned inside out.
SUSPECT = re.compile(
    "|".join(_sequence(e) for e in ("cp1252", "latin_1", "cp1251", "cp437", "cp850")) + "|" + _sequence("mac_roman", "[¬√ƒ‚„‰ÂÊÁËÈ]")
    + "|[\x80-\x9f\ufffd]|[\xa1-\xff]{4}|[‚ƒˆŠ‹ŒŽ][\xa1-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘-•—˜™š›œ]|[а-я][А-Я]{2}|Ј"
)
#: Where all of a match of SUSPECT lies.
HIGH = re.compile(r"[^\x00-\x7f][^\x00-\x7f]*")
#: Non-ASCII characters and up to two ASCII ones between them: blanks between words, trail bytes of East Asian encodings.
RUN = re.compile(r"[^\x00-\x7f]+(?:[ -~]{1,2}(?=[^\x00-\x7f])[^\x00-\x7f]+)*")


def suspect(text: str) -> bool:
    """Does SUSPECT match? Few characters of most texts need its many alternatives."""
    return SUSPECT.search(" ".join(HIGH.findall(text))) is not None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _pair_slots(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(43)).astype(np.int64)


def _char_slots(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint64(CHAR_SLOTS - 1)).astype(np.int64)


def _joined(texts: list[str]) -> np.ndarray:
    return _codes("\n".join(texts))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pairs, chars = np.zeros(PAIR_SLOTS, np.int64), np.zeros(CHAR_SLOTS, np.int64)
    example, fields = np.zeros(PAIR_SLOTS, np.int64), np.zeros(PAIR_SLOTS, np.int64)
    for pdf in batches:
        texts = [t for c in pdf.columns for t in pdf[c] if t and (t.isascii() or not SUSPECT.search(t))]
        if texts:
            codes = _joined(texts)
            slots = _pair_slots(codes)
            pairs += np.bincount(slots, minlength=PAIR_SLOTS)
            example[slots] = (codes[:-1] << np.uint64(21) | codes[1:]).astype(np.int64)
            chars += np.bincount(_char_slots(codes), minlength=CHAR_SLOTS)
            for t in texts:
                if not t.isascii():
                    fields[np.unique(_pair_slots(_codes(t)))] += 1
    for kind, table, of in ((0, pairs, example), (1, chars, None)):
        slot = np.flatnonzero(table)
        if len(slot):
            yield pd.DataFrame({"kind": np.int32(kind), "slot": slot.astype(np.int32), "n": table[slot], "pair": of[slot] if of is not None else np.int64(0), "fields": fields[slot] if of is not None else np.int64(0)})


UNSEEN = 255
#: Non-ASCII fields that must hold a pair, so that no field vouches for itself.
SEEN_IN = 2
#: Score from which a pair is suspicious: four bits less than chance, at every size of the corpus.
SUSPICIOUS = 160


class PairModel:
    """Scores of adjacent characters by mutual information in the clean corpus.

    ``odd`` holds a byte a slot: UNSEEN for pairs that fewer than SEEN_IN clean fields hold, otherwise 128 less
    eight times the pair's mutual information in bits, cut to 0 to 250. ``seen`` has character counts.
    """

    def __init__(self, odd: np.ndarray, seen: np.ndarray):
        self.odd, self.seen = odd, seen

    @classmethod
    def fit(cls, texts: DataFrame) -> PairModel:
        """Counts over all rows of all columns of ``texts``; at most PAIR_SLOTS + CHAR_SLOTS rows come back."""
        counts = texts.mapInPandas(_count, "kind int, slot int, n long, pair long, fields long").groupBy("kind", "slot").agg(F.sum("n").alias("n"), F.max("pair").alias("pair"), F.sum("fields").alias("fields"))
        got = counts.toPandas()
        pairs, chars, example, fields = np.zeros(PAIR_SLOTS), np.zeros(CHAR_SLOTS, np.float32), np.zeros(PAIR_SLOTS, np.int64), np.zeros(PAIR_SLOTS, np.int64)
        part = got[got["kind"] == 0]
        pairs[part["slot"].to_numpy()], example[part["slot"].to_numpy()] = part["n"].to_numpy(), part["pair"].to_numpy()
        fields[part["slot"].to_numpy()] = part["fields"].to_numpy()
        part = got[got["kind"] == 1]
        chars[part["slot"].to_numpy()] = part["n"].to_numpy()
        total = max(pairs.sum(), 1.0)
        p = np.maximum(chars.astype(np.float64), 1.0) / total
        first, second = (example >> 21) & (CHAR_SLOTS - 1), example & (CHAR_SLOTS - 1)
        information = np.log2(np.maximum(pairs, 1e-9) / total / p[first] / p[second])
        byte = np.where(fields < SEEN_IN, UNSEEN, np.clip(128 - 8 * information, 0, 250)).astype(np.uint8)
        return cls(byte, chars)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Of each adjacent pair: 1 where clean text lacks it, less the greater its mutual information, -0.5 for ASCII and usual pairs."""
        high = codes > 127
        odd = self.odd[_pair_slots(codes)].astype(np.float64)
        out = np.where(high[:-1] | high[1:], np.maximum((odd - SUSPICIOUS + 1) / (UNSEEN - SUSPICIOUS + 1), -0.5), -0.5)
        out[self._capitals(codes)] = 1.0
        return out

    def suspicious(self, codes: np.ndarray) -> np.ndarray:
        """For each adjacent pair: is its score above 0?"""
        return self.scores(codes) > 0

    @staticmethod
    def _capitals(codes: np.ndarray) -> np.ndarray:
        """First pairs of four Cyrillic capitals in a row, because lower case turns into them between two Cyrillic encodings."""
        out = np.zeros(max(len(codes) - 1, 0), bool)
        capital = (codes >= 0x410) & (codes <= 0x42F)
        if len(codes) > 3:
            four = capital[:-3] & capital[1:-2] & capital[2:-1] & capital[3:]
            out[: len(four)] |= four
        return out

    def oddness(self, text: str, left: str = " ", right: str = " ") -> float:
        """Mean score of the pairs with a non-ASCII character, UNSEEN for characters that clean text lacks."""
        codes = _codes(left + text + right)
        high = codes > 127
        at = high[:-1] | high[1:]
        if not at.any():
            return 0.0
        score = self.odd[_pair_slots(codes)[at]].astype(np.float64)
        lost = (codes == 0xFFFD) | (high & (self.seen[_char_slots(codes)] < 2))
        score[(lost[:-1] | lost[1:])[at]] = UNSEEN
        return float(score.mean())


def maximum_segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring stretches (start, end) of a score sequence, left to right."""
    out: list[tuple[int, int]] = []
    total, start, best, end = 0.0, None, 0.0, 0
    for i, s in enumerate(scores.tolist()):
        if start is None:
            if s > 0:
                start, total, best, end = i, s, s, i + 1
            continue
        total += s
        if total > best:
            best, end = total, i + 1
        elif total <= 0 or total < best - 4:
            out.append((start, end))
            start = None
    if start is not None:
        out.append((start, end))
    return out


def _as_bytes(run: str, encoding: str) -> bytes | None:
    try:
        return codecs.charmap_encode(run, "strict", _TO_BYTE[encoding])[0]
    except UnicodeEncodeError:
        return None


def _readings_of(run: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of every inverse mapping that takes ``run``: kind is utf8, east or swap."""
    done = set()
    for e in READINGS:
        raw = _as_bytes(run, e)
        if raw is None or raw in done or len(raw) < 2:
            continue
        done.add(raw)
        text = raw.decode("utf-8", "replace")
        good = sum(len(c.encode()) for c in text if c > "\x7f" and c != "\ufffd")
        high = sum(b > 127 for b in raw)
        if good >= 2 and good >= 0.5 * high:
            yield "utf8", text
        if len(raw) >= 4:
            for target in EAST if e in ("cp1252", "latin_1") else ():
                text = raw.decode(target, "replace")
                cjk = sum("\u3000" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" or "\uff00" <= c < "\uffef" for c in text)
                if cjk >= 2 and cjk >= 0.6 * sum(c > "\x7f" for c in text):
                    yield "east", text
        if len(raw) >= 2:
            for target in ("cp1251", "koi8_r") if e in ("cp1252", "latin_1", "cp1251", "koi8_r") else ():
                if target != e and (len(raw) >= 4 or e in ("cp1252", "latin_1")):
                    text = raw.decode(target, "replace")
                    if sum("\u0400" <= c <= "\u045f" for c in text) >= 0.7 * sum(c > "\x7f" for c in text):
                        yield "swap", text


#: How much less odd a mapping's text must be, in eighths of a bit of mutual information a pair.
MARGIN = 24
#: The same between Cyrillic encodings, whose letters all stay letters.
SWAP_MARGIN = 8


def invert(run: str, model: PairModel, left: str = " ", right: str = " ", depth: int = 0) -> tuple[str, bool] | None:
    """(original text of a garbled run, whether nothing of it is lost), or None where no mapping explains the run.

    Of all mappings the one whose text has the least odd pairs is taken, if it is MARGIN less odd
    than the run. Text that went through the wrong encoding twice is undone twice.
    """
    here = model.oddness(run, left, right)
    best: tuple[float, str, bool] | None = None
    for kind, text in _readings_of(run):
        whole = "\ufffd" not in text
        if kind == "utf8" and depth < 2 and (deeper := invert(text, model, left, right, depth + 1)):
            text, whole = deeper[0], deeper[1] and whole
        odd = model.oddness(text, left, right)
        swap = kind == "swap" and run[:1] >= "\u0400"
        if swap and odd >= 128:  # rare capitals are not undone to letters that are rarer together than by chance
            continue
        if odd <= here - (SWAP_MARGIN if swap else MARGIN) and (best is None or odd < best[0]):
            best = (odd, text, whole)
    return None if best is None else best[1:]


def invert_all(text: str, model: PairModel, restore: bool = True) -> tuple[str, bool] | None:
    """As invert, for every run inside ``text`` that holds an improbable pair; None where none is garbled.

    Without ``restore`` the first garbled run decides and the text comes back as it is.
    """
    if text.isascii():
        return None
    codes = _codes(text)
    scores = model.scores(codes)
    odd = scores > 0
    lost = "�" in text
    if not odd.any() and not lost:
        return None
    if lost and not restore:
        return text, False
    spans = maximum_segments(scores) if odd.any() else []
    first = _invert_runs(text, model, spans, not restore)
    if not first[1]:
        return (text, False) if lost else None
    if not restore:
        return text, False
    # a garbled field is garbled by one mapping: runs without an improbable pair are tried as well
    again = _invert_runs(text, model, [(0, len(text))])
    return again[0], again[2] and not lost


def _invert_runs(text: str, model: PairModel, spans: list[tuple[int, int]], first_only: bool = False) -> tuple[str, bool, bool]:
    """(text with the garbled runs around ``spans`` put right, whether there is any, whether nothing of it is lost)."""
    out, at, found, whole, k = [], 0, False, True, 0
    for m in RUN.finditer(text):
        while k < len(spans) and spans[k][1] + 1 < m.start():
            k += 1
        if k == len(spans):
            break
        if spans[k][0] >= m.end():
            continue
        run = m[0]
        left, right = text[m.start() - 1 : m.start()] or " ", text[m.end() : m.end() + 1] or " "
        if (got := invert(run, model, left, right)) is None and " " in run:
            words = run.split(" ")
            around = [left, *[" "] * (len(words) - 1), right]
            parts = [invert(w, model, around[i], around[i + 1]) for i, w in enumerate(words)]
            if any(parts):
                got = " ".join(p[0] if p else w for p, w in zip(parts, words, strict=True)), all(p is None or p[1] for p in parts)
        if got is None and any("\x80" <= c <= "\x9f" for c in run):
            got = run, False
        if got is not None:
            found, whole = True, whole and got[1]
            if first_only:
                break
            out += [text[at : m.start()], got[0]]
            at = m.end()
    return "".join(out) + text[at:], found, whole


def restore_texts(texts: list[str | None], model: PairModel, restore: bool = True) -> list[tuple[str, bool] | None]:
    """invert_all for many texts; texts without an improbable pair are passed over in one sweep."""
    out: list[tuple[str, bool] | None] = [None] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and not t.isascii()]
    if not rows:
        return out
    lengths = np.array([len(texts[i]) for i in rows])
    codes = _joined([texts[i] for i in rows])
    ends = np.cumsum(lengths + 1)
    odd = np.flatnonzero(model.suspicious(codes) | (codes[:-1] == 0xFFFD))
    hit = set(np.unique(np.searchsorted(ends, odd, side="right")).tolist())
    if len(codes) and codes[-1] == 0xFFFD:
        hit.add(len(rows) - 1)
    for k in sorted(hit):
        if k < len(rows):
            out[rows[k]] = invert_all(texts[rows[k]], model, restore)
    return out


PLAIN = READINGS[:6]
#: Which readings show a character for a byte that begins, or continues, a sequence of UTF-8.
_LEADS: dict[str, int] = {}
_TAILS: dict[str, int] = {}
for _k, _e in enumerate(PLAIN):
    for _c, _b in _TO_BYTE[_e].items():
        for _of, _lo, _hi in ((_LEADS, 0xC2, 0xF4), (_TAILS, 0x80, 0xBF)):
            if _lo <= _b <= _hi:
                _of[chr(_c)] = _of.get(chr(_c), 0) | 1 << _k
_LEAD, _TAIL = ("[" + re.escape("".join(x)) + "]" for x in (_LEADS, _TAILS))
STARTS = re.compile(_LEAD + _TAIL)
#: Non-ASCII runs that may be UTF-8 under some reading; the look behind the first character comes after it, which is found faster.
_LONG = re.compile(_LEAD + r"(?<![^\x00-\x7f]{2})" + _TAIL + r"[^\x00-\x7f]*")


def plain_restore(text: str) -> str | None:
    """``text`` with every non-ASCII run that is strict UTF-8 under some reading put right, without statistics; None if there is none."""
    changed = False
    if not STARTS.search(text):
        return None

    def fix(m: re.Match) -> str:
        nonlocal changed
        run = m[0]
        may = _LEADS.get(run[0], 0) & _TAILS.get(run[1], 0)
        for k, e in enumerate(PLAIN) if may else ():
            if may >> k & 1 and (raw := _as_bytes(run, e)):
                try:
                    got = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                changed = True
                return got
        return run

    out = _LONG.sub(fix, text)
    if changed and suspect(out):  # decoded wrongly twice
        return _LONG.sub(fix, out)
    return out if changed else None


def garbled_fields(pages: DataFrame, fields: tuple[str, ...] = ("title", "text"), id_column: str = "page_id", model: PairModel | None = None, restore: bool = True) -> DataFrame:
    """(id, field, restored, complete): every garbled field with its original text as far as it can be had, or null without ``restore``.

    ``complete`` is false where bytes are lost; what is lost shows as U+FFFD. Null, empty and
    ASCII fields are no cases. Each row is judged by itself, so repeated rows give repeated cases.
    """
    model = model or PairModel.fit(pages.select(*fields))
    sent = pages.sparkSession.sparkContext.broadcast((model.odd, model.seen))  # PAIR_SLOTS + 4 * CHAR_SLOTS bytes, always

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = PairModel(*sent.value)
        for pdf in batches:
            for f in fields:
                got = restore_texts(list(pdf[f]), at, restore)
                rows = [(i, f, r[0] if restore else None, r[1] if restore else None) for i, r in zip(pdf["__id"], got, strict=True) if r is not None]
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "field", "restored", "complete"])

    return pages.select(F.col(id_column).cast("long").alias("__id"), *fields).mapInPandas(run, "id long, field string, restored string, complete boolean")
