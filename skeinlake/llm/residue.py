"""Template residue, filler, error pages and script notices in place of content (problem 6).

Labelled exemplars are found through an inverted index over their words; a passage is judged by
TF-IDF containment both ways: how much of the exemplar it holds, and how much of it the exemplar
covers. Text about such things holds the words too, but is mostly not covered by them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled exemplars: messages of common servers, systems and page builders. "*" is a slot: a name, host, path or number
# that differs from page to page.
EXEMPLARS = {
    "error": (
        "404 Not Found", "403 Forbidden", "502 Bad Gateway", "Error 503 Service Unavailable", "500 Internal Server Error", "HTTP Status 500 – Internal Server Error",
        "Page not found", "Not Found", "Service unavailable", "Access denied", "Forbidden", "Bad Gateway", "Error establishing a database connection", "Too many requests",
        "Warning: include(): failed opening *", "Warning: include(*): failed to open stream: no such file or directory in * on line *", "The requested URL * was not found on this server.",
        "You do not have permission to access * on this server", "Reference # * . *", "This account has been suspended.", "Index of *", "Fehler *",
        "Seite nicht gefunden", "Zugriff verweigert", "Page introuvable", "Accès refusé", "Página no encontrada", "Acceso denegado", "Página não encontrada",
        "Страница не найдена", "Доступ запрещён", "ページが見つかりません", "页面未找到", "找不到页面", "您访问的页面*不存在",
    ),
    "script": (
        "Please enable JavaScript to view *.", "You need to enable JavaScript to run this app.", "Just a moment... Checking your browser before accessing *", "JavaScript is disabled in your browser", "Loading * …",
        "Bitte aktivieren Sie JavaScript, um * zu nutzen.", "Activez JavaScript puis rechargez la page.", "Active JavaScript para ver *.", "Ative o JavaScript para ver *.",
        "*を表示するにはJavaScriptを有効にしてください", "请启用JavaScript以查看*",
    ),
    "filler": (
        "Lorem ipsum dolor", "Sample page.", "Content coming soon.", "Text here", "Insert image", "Your text here", "Click here to edit this text",
        "Under construction", "Hello world! Welcome to your first post.", "Blindtext", "Texte de remplissage", "Texto de relleno", "Your * goes here",
    ),
}
# Exemplars labelled on pages of this project (sf0.1): what is common there and in no public list. Other collections
# bring their own through the parameter ``exemplars``.
PROJECT_EXEMPLARS = {
    "error": (
        "Error: no database", "java.lang.NullPointerException at example * Handler line *", "Fatal error uncaught exception in * line *", "Warning: include( * .inc): failed to open stream: No such file, line *",
        "The page you asked for on * could not be found.", "Check the address or return to the start page.", "Error *: no such document", "You do not have permission to open * here.",
        "Bad gateway. The upstream * sent no valid answer. Request no. *", "Fatal error: cannot connect to database * in * on line *", "Oops! We looked in every drawer of * but this page is gone.",
        "Contact the billing desk of * with ticket *.", "* is down for maintenance. We will be back within * minutes.", "Slow down, please. Limit of * calls per hour on * reached.",
        "* refuses requests from your network. Rule *", "Your session has expired. Please sign in to * again. Code *", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich bei * erneut an. Code *",
        "Die Seite * gibt es auf * nicht mehr.", "Désolé, la page * n’existe pas ou plus sur *.", "Lo sentimos: no existe ninguna página * en *. Código *", "Desculpe, a página * não existe em *.",
        "Ошибка *. Страница * на * не существует.", "*に*は存在しません。", "抱歉，*上没有*这个页面。错误*",
    ),
    "script": (
        "This application needs scripts. Build *", "You need to turn on scripts in your browser to run * *.", "Your browser is not supported. * runs only with scripting switched on; version *.",
        "Checking that you are not a robot before opening *.", "This needs cookies and JavaScript. Ray *", "If nothing happens, your browser may be blocking scripts (*).",
        "Bitte aktivieren Sie JavaScript, um * zu nutzen. (*)", "Pour afficher *, activez JavaScript puis rechargez. (*)", "Активируйте JavaScript, чтобы открыть * (*).",
        "*を表示するにはJavaScriptを有効にしてください (*)", "请启用JavaScript以查看* (*)",
    ),
    "filler": ("Placeholder paragraph", "Untitled template *", "Heading *"),
}
# Filler passages of any order of words: the classical one, and the one of this project's pages.
PASSAGES = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation "
    "ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint "
    "occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
)
PROJECT_PASSAGES = (PASSAGES[0] + " velo marun tepid egetas vitae vel pretio augur placer tellin semper luctor sodal morbi donek massa urna portam alta ornat nimis cursus fusce",)
# Exemplars of unfilled placeholders, by the marks that open them. They hold no words of their own, so the marks are
# their entries in the index.
PLACEHOLDERS = {
    "{{": r"\{\{[^{}\n]+\}\}", "${": r"\$\{[^{}\n]+\}", "#{": r"#\{[^{}\n]+\}", "{%": r"\{%[^%\n]+%\}", "<?": r"<\?=?[^?\n]+\?>", "<%": r"<%=?[^%\n]+%>", "[[": r"\[\[[A-Za-z_][\w.]*\]\]",
    "[": r"\[(?:INSERT|insert|Insert)\b[^\]\n]+\]|\[[a-z]+(?:[_.][a-z]+)+\]|\[[a-zA-Z]{3,24}\]", "@@": r"@@[\w.]{2,}?@@", "__": r"__[A-Za-z][\w.]+?__", "%": r"%[A-Za-z][A-Za-z_.]{2,}%",
    "{0}": r"\{0\}(?: ?\{1\})?", "TODO": r"\bTODO: write \w+", "goes here": r"\bYour [a-z_.]{3,30} goes here\b", "XXX": r"\bXXX+\b", "TBD": r"\bTBD\b",
}

WORD = re.compile(r"[^\W\d_぀-ヿ㐀-鿿가-힯]+|[぀-ヿ㐀-鿿가-힯]|\d+")
#: Hosts and paths are slots wherever they stand.
SLOT = re.compile(r"(?:[\w\-]+\.)+(?:test|example|invalid|localhost|[a-z]{2,4})(?![A-Za-z0-9])(?:/[!-~]*)?|/[A-Za-z0-9_\-/.%]+", re.IGNORECASE | re.ASCII)
PLACEHOLDER = {mark: re.compile(body) for mark, body in PLACEHOLDERS.items()}
#: What every placeholder has.
MARKS = re.compile("|".join(re.escape(m) for m in PLACEHOLDERS))
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
#: Where a sentence, a line or a part of a menu ends.
BOUND = re.compile(r"[\n。！？|｜·•>»›]|[.!?…](?=\s|$)|\s[–—/-]\s")
QUOTED = re.compile(r"“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|「[^」\n]*」|\"[^\"\n]*\"|`[^`\n]*`")
#: An exemplar of as many words is a notice wherever it stands; two East Asian characters are a word.
FREE_WORDS = 5
#: Words of a window of a filler passage, or of a shorter field, and the least number of its words in it.
PASSAGE_WORDS, PASSAGE_LEAST = 8, 5
#: Placeholders between quotes or code marks are quoted, and variables of a shell are its own.
MENTION = re.compile(r"[`'\"“”‘’«»„「」]\s*$")
ENVIRONMENT = re.compile(r"[$#]\{?(?:HOME|PATH|USER|SHELL|PWD|LANG|TMPDIR|EDITOR|HOSTNAME|TERM)\b")
BRACKET_WORDS = frozenset(("sic", "edit", "note", "map", "pdf", "video", "audio", "photo", "update", "updated", "live", "hide", "show", "top", "more", "link"))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Finder:
    """The words of ``vocabulary`` in texts. Words never cross blanks, and stretches between blanks recur, so what they hold is
    kept for up to KEPT of them, none longer than LONGEST."""

    KEPT, LONGEST = 1 << 17, 40

    def __init__(self, vocabulary: frozenset[str]):
        self.vocabulary = vocabulary
        self.some: dict[str, frozenset[str]] = {}
        self.none: set[str] = set()

    def __call__(self, text: str) -> set[str]:
        left = set(text.split()).difference(self.none)
        new = left.difference(self.some)
        found = set().union(*map(self.some.__getitem__, left - new if new else left))
        if new:
            here = self.vocabulary.intersection(words(" ".join(new)))
            found |= here
            kept = [x for x in new if len(x) <= self.LONGEST]
            if len(self.some) + len(self.none) + len(kept) > self.KEPT:
                self.some.clear()
                self.none.clear()
            for x in kept if len(kept) <= self.KEPT else ():
                if here and (own := here.intersection(words(x))):
                    self.some[x] = own
                else:
                    self.none.add(x)
        return found


class Exemplars:
    """Labelled exemplars and filler passages with the words that the index holds."""

    def __init__(self, labelled: tuple[dict[str, tuple[str, ...]], ...] = (EXEMPLARS, PROJECT_EXEMPLARS), passages: tuple[str, ...] = PASSAGES + PROJECT_PASSAGES):
        self.rows: list[tuple[str, Counter, int]] = []
        for group in labelled:
            for label, texts in group.items():
                for t in texts:
                    w = [x for x in words(t) if not x.isdigit() or x in ("404", "403", "500", "502", "503")]
                    self.rows.append((label, Counter(w), t.count("*")))
        self.passages = [frozenset(words(p)) for p in passages]
        self.vocabulary = frozenset(w for _, c, _ in self.rows for w in c).union(*self.passages)


DEFAULT = Exemplars()


class Retriever:
    """The exemplars behind an inverted index, weighted by how rare their words are in the corpus.

    ``df`` has the document frequency of the exemplars' words and ``n`` the number of documents.
    """

    def __init__(self, df: dict[str, int], n: int, exemplars: Exemplars = DEFAULT, contained: float = 0.85, covered: float = 0.8):
        self.vocabulary, self.passages = exemplars.vocabulary, exemplars.passages
        self.found = Finder(self.vocabulary)
        self.weight = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 0.2 for w in self.vocabulary}
        self.unknown = math.log(n + 1) * 0.5 + 0.2  # a word outside the exemplars
        self.contained, self.covered = contained, covered
        self.exemplars = exemplars.rows
        self.total = [sum(self.weight[w] * k for w, k in c.items()) for _, c, _ in self.exemplars]
        self.width = [sum(c.values()) + (slots + 1 if slots else 0) for _, c, slots in self.exemplars]  # words of a window
        # the rarest words of each exemplar that weigh more than may be missing; a passage must have one of them
        self.index: dict[str, list[int]] = defaultdict(list)
        self.rare: list[list[str]] = [[] for _ in self.exemplars]
        for i, (_, c, _) in enumerate(self.exemplars):
            left = (1 - self.contained) * self.total[i]
            for w in sorted(c, key=lambda w: (-self.weight[w] * c[w], w)):
                self.index[w].append(i)
                self.rare[i].append(w)
                left -= self.weight[w] * c[w]
                if left < 0:
                    break
        self.entries = frozenset(self.index)

    def candidates(self, found: set[str]) -> list[int]:
        """Exemplars that a passage made of the words ``found`` can hold."""
        near = {i for w in found & self.entries for i in self.index[w]}
        return sorted(i for i in near if sum(self.weight[w] * k for w, k in self.exemplars[i][1].items() if w in found) >= self.contained * self.total[i])

    def accepts(self, i: int, got: Counter) -> bool:
        """Does a passage of the words ``got`` hold exemplar ``i``, and the exemplar cover the passage?"""
        _, want, slots = self.exemplars[i]
        held = sum(self.weight[w] * k for w, k in (got & want).items())
        if held < self.contained * self.total[i]:
            return False
        rest = got - want
        # slots are filled by words of any kind: as many of the other words are free, and one more for a site's name
        free = slots + 1 if slots else 1
        costs = sorted((self.weight.get(w, self.unknown) for w, k in rest.items() for _ in range(k)), reverse=True)[free:]
        if len(rest) > 2 * free + 2:
            return False
        return held >= self.covered * (held + sum(costs)) and bool(slots or sum(want.values()) > 1 or sum(rest.values()) == 0)

    def passage(self, text: str, among: list[int]) -> str | None:
        """Label of the exemplar in ``among`` that holds and covers ``text``, or None."""
        got = Counter(w for w in words(SLOT.sub(" ", text)) if not w.isdigit() or w in self.vocabulary)
        return next((self.exemplars[i][0] for i in among if got and self.accepts(i, got)), None)

    def window(self, text: str, among: list[int]) -> str | None:
        """Label of the exemplar in ``among`` that some window of ``text`` holds, across lines, or None.

        A window is as long as its exemplar with its slots filled. Exemplars of fewer than FREE_WORDS words are also
        used in prose; their windows begin and end where a sentence, a line or a part of a menu does. What stands
        between quotation marks is a mention.
        """
        text = SLOT.sub(" ", text)
        tokens = [w for x in WORD.findall(text) if not (w := x.lower()).isdigit() or w in self.vocabulary]
        wanted = {w for i in among for w in self.exemplars[i][1]}
        places: dict[str, list[int]] = defaultdict(list)
        for k, w in enumerate(tokens):
            if w in wanted:
                places[w].append(k)
        near = {i: at for i in among if (at := self._near(i, tokens, places))}
        if not near:
            return None
        spans = [(m.start(), m.end()) for m in WORD.finditer(text) if not (w := m[0].lower()).isdigit() or w in self.vocabulary]
        edges: dict[int, bool] = {}
        quoted = [m.span() for m in QUOTED.finditer(text)]
        starts = [a for a, _ in quoted]

        def edge(k: int) -> bool:
            """Does a sentence, a line or a part end before word ``k``?"""
            if k not in edges:
                edges[k] = k in (0, len(spans)) or BOUND.search(text, spans[k - 1][1], spans[k][0]) is not None
            return edges[k]

        for i, starting in near.items():
            label, want, _ = self.exemplars[i]
            width = self.width[i]
            short = sum(k if w < "\u3040" else 0.5 * k for w, k in want.items()) < FREE_WORDS
            for at in starting:
                q = bisect_right(starts, spans[at][0]) - 1
                if (q >= 0 and spans[at][0] < quoted[q][1]) or (short and not edge(at)):
                    continue
                end = min(at + width, len(tokens))
                if short:
                    ends = [k for k in range(at + 1, end + 1) if edge(k)]
                else:
                    while tokens[end - 1] not in want:
                        end -= 1
                    ends = [end]
                if any(self.accepts(i, Counter(tokens[at:k])) for k in ends):
                    return label
        return None

    def _near(self, i: int, tokens: list[str], places: dict[str, list[int]]) -> list[int]:
        """Where windows begin whose words can hold exemplar ``i``; ``places`` has those of its words in ``tokens``."""
        want, width = self.exemplars[i][1], self.width[i]
        anchors = sorted(k for w in self.rare[i] for k in places.get(w, ()))  # a window must have one of them
        out = []
        for at in sorted(k for w in want for k in places.get(w, ())) if anchors else ():
            a = bisect_left(anchors, at)
            if a < len(anchors) and anchors[a] < at + width:
                here = set(tokens[at : at + width])
                if sum(self.weight[w] * k for w, k in want.items() if w in here) >= self.contained * self.total[i] - 1e-9:
                    out.append(at)
        return out

    def filler(self, text: str) -> bool:
        """Does a filler passage cover some window of ``text``, by the weight of its words?"""
        found = words(text)
        weight = [self.weight.get(w, self.unknown) for w in found]
        width = min(PASSAGE_WORDS, len(found))
        for passage in self.passages:
            flags = [w in passage for w in found]
            if sum(flags) < PASSAGE_LEAST:
                continue
            held, total, n = 0.0, 0.0, 0
            for i, (f, x) in enumerate(zip(flags, weight, strict=True)):
                total += x
                held += x * f
                n += f
                if i >= width:
                    total -= weight[i - width]
                    held -= weight[i - width] * flags[i - width]
                    n -= flags[i - width]
                if i + 1 >= width and n >= min(PASSAGE_LEAST, width) and held >= self.contained * total:
                    return True
        return False

    @staticmethod
    def placeholder(text: str) -> bool:
        """Does ``text`` hold an unfilled placeholder that is neither quoted nor a word in brackets?"""
        for mark in set(MARKS.findall(text)) | ({"["} if "[" in text else set()):
            for m in PLACEHOLDER[mark].finditer(text):
                g = m[0]
                if ENVIRONMENT.match(g) or MENTION.search(text[max(0, m.start() - 2) : m.start()]):
                    continue
                if g[0] == "[" and g[1] != "[" and "_" not in g and "." not in g and not g[1:7].lower() == "insert" and (g[1:-1].lower() in BRACKET_WORDS or not _lone(text, m)):
                    continue
                return True
        return False

    def label(self, text: str) -> str | None:
        """Label of a whole field, by its passages; None where it is content."""
        if MARKS.search(text) and self.placeholder(text):
            return "placeholder"
        found = self.found(text)
        if among := self.candidates(found):
            lines = [(line, here) for line in text.split("\n") if (here := self.candidates(self.found(line)))]
            for line, here in lines:
                if label := self.passage(line, here):
                    return label
            for line, here in lines:
                if len(line) > 60:
                    for x in SENTENCE.split(line):
                        if len(x) > 12 and len(WORD.findall(x)) >= 5 and (label := self.passage(x, here)) and label != "filler":
                            return label
            if label := self.window(text, among):
                return label
        if any(len(found & p) >= PASSAGE_LEAST for p in self.passages) and self.filler(text):
            return "filler"
        return None


def _lone(text: str, m: re.Match) -> bool:
    """Is a bracketed word all of its line, but for a site's name, or upper case?"""
    start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
    rest = WORD.findall(text[start : m.start()] + " " + text[m.end() : end if end >= 0 else len(text)])
    return len(rest) <= 2 or (m[0].isupper() and len(rest) <= 4)


def document_frequencies(fields: DataFrame, vocabulary: frozenset[str] = DEFAULT.vocabulary) -> tuple[dict[str, int], int]:
    """Document frequencies of ``vocabulary`` over all rows of all columns; one row a word comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        found = Finder(vocabulary)
        for pdf in batches:
            for c in pdf.columns:
                for t in pdf[c]:
                    if t:
                        df.update(found(t))
                        df[""] += 1
        yield pd.DataFrame({"word": list(df), "n": list(df.values())})

    got = {r["word"]: r["n"] for r in fields.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop("", 0)


def residue_fields(pages: DataFrame, fields: tuple[str, ...] = ("title", "text"), id_column: str = "page_id", exemplars: Exemplars = DEFAULT, counted: tuple[str, ...] | None = None) -> DataFrame:
    """(id, field, label) of every one of ``fields`` that is or contains residue.

    Labels: placeholder, filler, error, script. Null and empty fields are no cases; each row is
    judged by itself. Text that went through a wrong encoding is read both ways. Words are counted in
    ``counted``, by default in ``fields``.
    """
    from skeinlake.llm.garble import plain_restore

    df, n = document_frequencies(pages.select(*(counted or fields)), exemplars.vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Retriever(df, n, exemplars)
        for pdf in batches:
            rows = []
            for f in fields:
                for i, t in zip(pdf["__id"], pdf[f], strict=True):
                    if t:
                        label = judge.label(t)
                        if label is None and not t.isascii() and (fixed := plain_restore(t)) is not None:
                            label = judge.label(fixed)
                        if label:
                            rows.append((i, f, label))
            if rows:
                yield pd.DataFrame(rows, columns=["id", "field", "label"])

    return pages.select(F.col(id_column).cast("long").alias("__id"), *fields).mapInPandas(run, "id long, field string, label string")
