"""Text operators against brute force, round trips and awkward input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import golay
from skeinlake.llm.boilerplate import boilerplate_lines, main_body, simple_tree_matching
from skeinlake.llm.garble import PairModel, garbled_fields, maximum_segments, plain_restore
from skeinlake.llm.leakage import align, leaks
from skeinlake.llm.near_dup import components, near_duplicate_groups, near_duplicate_pairs, tokens
from skeinlake.llm.packing import pack
from skeinlake.llm.residue import residue_fields
from skeinlake.llm.sentences import sentence_spans, sentences

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo", "sha", "pe") for b in ("rin", "dal", "mos", "tek", "bur", "nif", "lan", "wex", "gos", "zum", "pir", "cad")]
PAGE = "page_id long, url string, title string, text string, id string, rep long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], PAGE)


# --- near duplicates -----------------------------------------------------------------------------------------------


def test_golay_keys():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 300)
    keys, n = golay.fuzzy_keys(w)
    assert set(n.tolist()) <= {1, 6}
    for d in (1, 2):
        flips = np.array([sum(1 << b for b in rng.choice(23, d, replace=False)) for _ in w])
        other, m = golay.fuzzy_keys(w ^ flips)
        assert all(set(a[:i]) & set(b[:j]) for a, i, b, j in zip(keys, n, other, m, strict=True))
    assert len(np.unique(golay.syndrome(np.arange(1 << 12) << 11))) == 1 << 11


def shingles(t):
    w = t.lower().split()
    return set(zip(w, w[1:], w[2:]))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(30):
        base = prose(rng, rng.randrange(90, 200)).split()
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 14)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                cut = rng.randrange(len(w))
                w = w[cut:] + w[:cut]
            rows.append((n, "u", None, " ".join(w)))
            n += 1
    rows += [(n + k, "u", None, rows[0][3]) for k in range(4)] + [(900, "u", None, None), (901, "u", None, ""), (902, "u", None, "short text"), (903, "u", None, "a " * 50000), (904, "u", None, "a " * 50000), rows[0]]
    want = set()
    sets = {i: shingles(t) for i, _, _, t in rows if t and len(t.split()) >= 80}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                want.add((a, b))
    got = near_duplicate_pairs(pages_of(spark, rows)).select("id_a", "id_b").collect()
    assert len(got) == len(set(map(tuple, got)))
    found = set(map(tuple, got))
    assert not found - want and len(found & want) >= 0.99 * len(want)


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    from skeinlake.llm import near_dup

    rng = random.Random(11)
    base = prose(rng, 120).split()
    rows = []
    for n in range(60):
        w = list(base)
        w[n % 120] = f"own{n}"
        rows.append((n, "u", None, " ".join(w)))
    plain = {tuple(r) for r in near_duplicate_pairs(pages_of(spark, rows)).select("id_a", "id_b").collect()}
    monkeypatch.setattr(near_dup, "HOT_BUCKET", 7)
    assert {tuple(r) for r in near_duplicate_pairs(pages_of(spark, rows)).select("id_a", "id_b").collect()} == plain and len(plain) == 60 * 59 // 2


def test_groups_of_every_language_and_length(spark):
    """Classes and links against brute force, with scripts without blanks, short texts and copies."""
    rng = random.Random(23)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    rows, n = [], 0
    for k in range(40):
        cjk = k % 2
        base = [rng.choice(signs if cjk else WORDS) for _ in range(rng.randrange(6, 150))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(signs if cjk else WORDS)
            rows.append((n, "u", None, ("" if cjk else " ").join(w)))
            n += 1
    rows += [(900, "u", None, "a b"), (901, "u", None, "A  b"), (902, "u", None, "x"), (903, "u", None, " "), (904, "u", None, None), (905, "u", None, rows[0][3]), rows[0]]
    cut = {i: tokens(t) for i, _, _, t in rows if t and t.split()}
    sets = {i: set(zip(*(w[k:] for k in range(5)))) for i, w in cut.items()}
    up, links = {i: i for i in cut}, {i: set() for i in cut}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in cut:
        for b in cut:
            near = bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if a < b and (near or cut[a] == cut[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
            if near and cut[a] != cut[b]:
                links[a].add(tuple(cut[b]))
    got = {r["id"]: (r["class"], r["links"]) for r in near_duplicate_groups(pages_of(spark, rows)).collect()}
    assert set(got) == set(cut)
    right = sum(got[i] == (root(i), len(links[i])) for i in cut)
    assert right >= 0.97 * len(cut)
    exact = {r["id"]: (r["class"], r["links"]) for r in near_duplicate_groups(pages_of(spark, rows), exact=True).collect()}
    assert sum(exact[i] == (root(i), len(links[i])) for i in cut) >= right
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["class"] for r in components(chain).collect()} == {0}


def test_near_duplicates_of_nothing(spark):
    assert near_duplicate_pairs(pages_of(spark, [(1, "u", None, None)]).limit(0)).count() == 0


# --- garbled text ----------------------------------------------------------------------------------------------------

CLEAN = ["Été à la forêt, près du café où l’élève a réparé le vélo.", "Über die Brücke fährt später ein grüner Zug nach Köln.", "Там же общий журнал хранится, а не новая песня.", "この地図には小さな記録がある。", "La señora pidió más páginas y años.",
         "ÅSÉN · ÂNGELA · SÃO Pedro 31 °C", "Price: £254 (≈ ¥25400), §254 ½", "Ã, Â and â are letters of lesson 830.", "plain ASCII only", "│ tide │ 4,4 m │ ±0,2 │"]
BREAK = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "cp1252")]


def test_garbled_round_trip(spark):
    rows = [(i * 100 + k, "u", None, t) for k in range(60) for i, t in enumerate(CLEAN)]
    broken = {}
    for n, (enc, dec) in enumerate(BREAK):
        for i in (0, 1, 2, 4):
            try:
                bad = CLEAN[i].encode(enc).decode(dec)
            except UnicodeError:
                continue
            if bad != CLEAN[i]:
                broken[50000 + n * 10 + i] = CLEAN[i]
                rows.append((50000 + n * 10 + i, "u", bad, "x"))
    rows += [(60000, "u", "caf�", None), (60001, "u", "", ""), (60002, "u", None, None), (60003, "u", "é" * 100000, "a" * 100000)]
    got = {(r["id"], r["field"]): (r["restored"], r["complete"]) for r in garbled_fields(pages_of(spark, rows)).collect()}
    assert {k for k in got if k[0] < 50000} == set()
    assert got.pop((60000, "title"))[1] is False
    hit = [i for i in broken if (i, "title") in got]
    assert len(hit) >= 0.9 * len(broken)
    assert sum(got[i, "title"][0] == broken[i] for i in hit) >= 0.9 * len(hit)
    assert garbled_fields(pages_of(spark, rows).limit(0), model=PairModel(np.zeros(1 << 21, np.uint8), np.zeros(1 << 16, np.float32))).count() == 0
    assert garbled_fields(pages_of(spark, [(1, "u", None, "plain")])).count() == 0


def test_segments_and_plain_restore():
    assert maximum_segments(np.array([-1.0, 2, -0.5, 1, -9, 1])) == [(1, 4), (5, 6)]
    assert plain_restore("cafÃ© ok") == "café ok" and plain_restore("café") is None
    assert plain_restore("é".encode().decode("cp1252").encode().decode("cp1252")) == "é"

def test_few_characters_tell_what_is_suspect():
    from skeinlake.llm import garble

    texts = list(odd_texts(random.Random(30), 400)) + ["", "a", "é", "aЈa", "дД", "дДД", "Â ", "Ã a©", "Ã©"]
    hits = [garble.SUSPECT.search(t) is not None for t in texts]
    assert [garble.suspect(t) for t in texts] == hits and 20 < sum(hits) < len(hits) - 20

def test_garbled_fields_do_not_vouch_for_themselves(spark):
    rows = [(i * 100 + k, "u", None, t) for k in range(60) for i, t in enumerate(CLEAN)]
    bad = {70000: "общий журнал".encode().decode("koi8_r"), 70001: "Там же".encode("cp1251").decode("cp1252")}
    got = {(r["id"], r["field"]) for r in garbled_fields(pages_of(spark, rows + [(i, "u", t, "x") for i, t in bad.items()])).collect()}
    assert got == {(i, "title") for i in bad}


def test_pair_scores_do_not_depend_on_size(spark):
    rows = [(i * 100 + k, "u", None, t) for k in range(3) for i, t in enumerate(CLEAN)]
    small, large = (PairModel.fit(pages_of(spark, rows * k).select("title", "text")) for k in (1, 400))
    at = np.frombuffer("".join(CLEAN).encode("utf-32-le"), np.uint32).astype(np.uint64)
    assert (small.suspicious(at) == large.suspicious(at)).all()


# --- residue -------------------------------------------------------------------------------------------------------------


def test_residue(spark):
    cases = ["404 Not Found", "{{title}} | Kalo", "Lorem ipsum dolor sit amet velo marun tepid velo", "Please enable JavaScript to view kalo.test.", "The requested URL /kalo was not found on this server.",
             "A long line about maps and charts [INSERT headline HERE] went on.", "Désolé, la page /kalo n’existe pas ou plus sur kalo.test.", "DÃ©solÃ©, la page /kalo nâ€™existe pas ou plus sur kalo.test.", "Your headline goes here",
             "Some modest pages mention Kalo.\n__section__\nOthers don't."]
    fine = ["Many viewers in Kalo asked why the notice “please enable JavaScript” was stored 214 times; the answer fills this note.", "Error 500 became a joke in Kalo, where a café of that name sells cake number 556.",
            "When a server answers 404 Not Found, Kalo still keeps the record, because the error itself is evidence.", "The old engine replaces `{{ title }}` with the heading of each page.",
            "Write ${HOME} in the script of Kalo and the shell puts the folder there.", "Typesetters once used lorem ipsum to judge a column of 593 lines.", "He wrote [sic] in the note.", None, "", "word " * 20000]
    rows = [(i, "u", None, t) for i, t in enumerate(cases)] + [(100 + i, "u", t, t) for i, t in enumerate(fine)] + [(0, "u", None, cases[0])]
    got = residue_fields(pages_of(spark, rows)).collect()
    assert {(r["id"], r["field"]) for r in got} == {(i, "text") for i in range(len(cases))}
    assert sum(r["id"] == 0 for r in got) == 2
    assert residue_fields(pages_of(spark, rows).limit(0)).count() == 0

def test_residue_inside_other_text(spark):
    rng = random.Random(25)
    cases = [f"{prose(rng, 12)}. Access denied. {prose(rng, 12)}.", f"{prose(rng, 12)} | Page not found | {prose(rng, 3)}", f"{prose(rng, 20)}.\nNot\nFound\n{prose(rng, 20)}.",
             f"Home News About {prose(rng, 14)} The requested URL /kalo was not found on this server {prose(rng, 14)}", f"{prose(rng, 9)}\nYou do not have permission\nto access /kalo on this server\n{prose(rng, 9)}",
             f"{prose(rng, 12)}. Your text here. {prose(rng, 12)}.", f"{prose(rng, 12)} Oops! We looked in every drawer of kalo.test but the page is gone. {prose(rng, 12)}"]
    fine = ["When a server answers 404 Not Found, Kalo still keeps the record.", "Kalo wrote “You do not have permission to access it on this server” on the wall of the café and went home.", "She was not denied access to the page that he found."]
    rows = [(i, "u", None, t) for i, t in enumerate(cases)] + [(100 + i, "u", None, t) for i, t in enumerate(fine)] + [(200 + i, "u", None, prose(rng, 60)) for i in range(200)]
    assert {r["id"] for r in residue_fields(pages_of(spark, rows)).collect()} == set(range(len(cases)))

def test_garbled_residue_in_long_fields(spark):
    rng = random.Random(26)
    bad = [x.encode().decode("cp1252", "replace") for x in ("Désolé, la page /kalo n’existe pas ou plus sur kalo.test.", "Lo sentimos: no existe ninguna página /kalo en kalo.test. Código 4")]
    rows = [(i, "u", None, f"{prose(rng, 90)}.\n{x}\n{prose(rng, 90)}.") for i, x in enumerate(bad)] + [(100 + i, "u", None, prose(rng, 180) + " cafÃ©") for i in range(50)]
    assert {r["id"] for r in residue_fields(pages_of(spark, rows)).collect()} == {0, 1}

def odd_texts(rng, n):
    """Texts with blanks, digits, scripts and letters that change length or form with their case, whole or garbled."""
    odd = " \t\x1c\x85\u3000.-_/|·»©ΣςİßŉÅ²٣0123'’é„“中ア가\u0307\u200bЈ\x81\ufffd"
    for _ in range(n):
        x = list(f"{prose(rng, 20)} Not Found\nKalo Page 404 · 12 Index of it · The end\n\n© 2024 Kalo. Text here 7x7")
        for _ in range(rng.randrange(30)):
            x.insert(rng.randrange(len(x) + 1), rng.choice(odd))
        x = "".join(x)
        yield rng.choice((x, x, x.upper(), x.encode().decode("cp1252", "replace"), x.encode().decode("latin_1")))

def test_recurring_stretches_are_read_once(monkeypatch):
    from skeinlake.llm import residue

    rng = random.Random(27)
    texts = [f"{prose(rng, 200)} We access it." for _ in range(200)]
    read, words = [], residue.words
    monkeypatch.setattr(residue, "words", lambda t: read.append(len(t)) or words(t))
    judge = residue.Retriever({}, 1000)
    assert all(judge.label(t) is None for t in texts) and judge.label(texts[0] + "\nAccess denied.") == "error"
    assert sum(read) < 0.2 * sum(map(len, texts))

def test_words_of_a_vocabulary_by_stretches():
    from skeinlake.llm import residue

    rng = random.Random(28)
    vocabulary = residue.DEFAULT.vocabulary | {"σς", "kalo", "中", "é"}
    for kept, longest in ((1 << 17, 40), (50, 40), (3, 5), (0, 0)):
        finder = residue.Finder(vocabulary)
        finder.KEPT, finder.LONGEST = kept, longest
        for t in odd_texts(rng, 150):
            assert finder(t) == vocabulary.intersection(residue.words(t)) and len(finder.some) + len(finder.none) <= kept


# --- boilerplate -------------------------------------------------------------------------------------------------------------


def test_tree_matching_is_the_longest_common_order():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(7))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (a[i] == b[j]))
        size, pairs = simple_tree_matching([(x, []) for x in a], [(x, []) for x in b])
        assert size == best[-1][-1] == len(pairs) and all(a[i] == b[j] for i, j in pairs)
    assert simple_tree_matching([(1, [(2, []), (3, [])])], [(1, [(3, [])])])[0] == 2


def test_names_and_numbers_leave_a_page_at_once(monkeypatch):
    from skeinlake.llm import boilerplate as b

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def sub(self, *a):
            self.calls += 1
            return self.pattern.sub(*a)

    digits, name = Counted(b.DIGITS), Counted(b.NAME)
    monkeypatch.setattr(b, "DIGITS", digits)
    monkeypatch.setattr(b, "NAME", name)
    rng = random.Random(29)
    texts = [t for t in odd_texts(rng, 300) if not b.plain_restore(t)] + ["", "\n \n", "7", "A · B\nKalo 7", "12 Kalo"]

    def folded(s, site):
        s = re.sub(r"\d+", "0", s.casefold())
        s = s.replace(site, "*") if len(site) > 3 else s
        return b.HOLDER.sub(r"\1 0 *", s) if "©" in s or "(c)" in s or "copyright" in s else s

    def bare(line):
        s = re.sub(r"\d+", "0", b.NAME.pattern.sub("*", line))
        if (one := b.PLAIN.search(s)) and b.PLAIN.search(s, one.end()):
            return b._hash(s)
        head, _, rest = line.partition(" ")
        s = head + " " + re.sub(r"\d+", "0", b.NAME.pattern.sub("*", rest))
        return b._hash(s) if rest and (b.PLAIN.search(s[len(head) :]) or " | " in s or " · " in s) else 0

    for t in texts:
        site = rng.choice(("", "kalo", " the", "kalo\npage", "found"))
        nos, sigs, skeletons, _, parts, lens = b.page_tree(t, site)
        lines = [(n, x.strip()) for n, x in enumerate(t.split("\n"), 1) if x.strip()]
        assert nos == [n for n, _ in lines] and sigs == [b._hash(folded(x, site)) for _, x in lines] and skeletons == [bare(x) for _, x in lines]
        assert all(p == [b._hash(folded(y, site)) for y in b.PARTS.split(x)] for p, (_, x) in zip(parts, lines, strict=True) if p)
        assert all(n in (0, len(x)) for n, (_, x) in zip(lens, lines, strict=True))
    assert digits.calls <= len(texts) and name.calls <= len(texts)

def test_boilerplate(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for n in range(160):
        host = f"site{n % 4}.test"
        body = [f"{prose(rng, 30)}. {prose(rng, 9)}." for _ in range(4)]
        lines = [("Home · About · Shop · News", 1), (f"Home / The {prose(rng, 2)} of Kalo", 1), *((x, 0) for x in body[:2]), ("", 0), ("You may also like", 1), (f"How {prose(rng, 1)} lost its {prose(rng, 1)}", 1),
                 *((x, 0) for x in body[2:]), (f"© 20{n % 90 + 10} Site{n % 4}. All rights reserved.", 1)]
        rows.append((n, f"https://www.{host}/{n}", None, "\n".join(x for x, _ in lines)))
        want |= {(n, k) for k, (_, b) in enumerate(lines, 1) if b}
    rows += [(900, None, None, None), (901, "no url", None, ""), (902, "https://site0.test/x", None, prose(rng, 60000))]
    df = pages_of(spark, rows)
    got = {tuple(r) for r in boilerplate_lines(df).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    bodies = {r["page_id"]: r["body"] for r in main_body(df.where(F.col("page_id").isin(0, 900, 902)).unionByName(df.where("page_id between 1 and 100"))).collect()}
    assert bodies[900] is None and bodies[902] == rows[-1][3]
    assert boilerplate_lines(df.limit(0)).count() == 0

def test_long_lines_and_long_menus_are_voted_on(spark):
    rng = random.Random(21)
    cookie = f"Kalo keeps {prose(rng, 20)} so that it knows your settings, and shares {prose(rng, 8)} with nobody."
    menu = " · ".join(f"Section {w.capitalize()}" for w in WORDS[:20])
    bodies = [f"{prose(rng, 40)}. {prose(rng, 9)}." for _ in range(24)]
    bodies[20:] = [bodies[0] + "\n" + bodies[1]] * 4  # copies make no template
    rows = [(n, f"https://long.test/{n}", None, f"{menu}\n{cookie}\n{b}\nSeen by Kalo") for n, b in enumerate(bodies)]
    got = {tuple(r) for r in boilerplate_lines(pages_of(spark, rows)).collect()}
    assert got == {(n, k) for n, b in enumerate(bodies) for k in (1, 2, b.count("\n") + 4)}

def test_lines_on_few_pages_of_a_host_are_constant(spark):
    rng = random.Random(22)
    rows, want = [], set()
    for h in range(12):
        for n in range(40):
            own = [f"{prose(rng, 40)}. {prose(rng, 9)}." for _ in range(2)]
            few = [f"Write to the desk of section {WORDS[h]} at noon."] if n % 13 == h % 13 else []  # on 3 or 4 of the host's 40 pages
            want |= {(h * 40 + n, 3) for _ in few}
            rows.append((h * 40 + n, f"https://host{h}.test/{n}", None, "\n".join(own + few)))
    assert {tuple(r) for r in boilerplate_lines(pages_of(spark, rows)).collect()} == want

def listed_pages(rng):
    """Twelve hosts with lists of two links, one with lists of twelve; (rows, lines that are boilerplate)."""
    rows, want = [], set()
    for h in range(13):
        for n in range(10):
            links = [f"How {prose(rng, 1)} lost its {prose(rng, 1)}" for _ in range(12 if h == 12 else 2)]
            text = [f"{prose(rng, 40)}. {prose(rng, 9)}.", "You may also like", *links]
            rows.append((h * 10 + n, f"https://list{h}.test/{n}", None, "\n".join(text)))
            want |= {(h * 10 + n, k) for k in range(2, len(text) + 1)}
    return rows, want


def test_long_link_lists_are_whole(spark):
    rows, want = listed_pages(random.Random(23))
    assert {tuple(r) for r in boilerplate_lines(pages_of(spark, rows)).collect()} == want

def test_templates_that_travel_with_pages_give_the_same(spark, monkeypatch):
    from skeinlake.llm import boilerplate

    rng = random.Random(24)
    rows, _ = listed_pages(rng)
    for h in range(12):  # behind the notice mostly stands a line that is constant on its host only, so the notice is no list head
        for n in range(10):
            behind = f"kept near {WORDS[h]} and {WORDS[h + 20]}" if n else f"About {prose(rng, 2)}"
            rows.append((1000 + h * 10 + n, f"https://kept{h}.test/{n}", None, f"{prose(rng, 40)}. {prose(rng, 9)}.\nA notice to all\n{behind}"))
    rows.append((900, "https://alone.test/", None, "One line. Two."))
    plain = sorted(map(tuple, boilerplate_lines(pages_of(spark, rows)).collect()))
    monkeypatch.setattr(boilerplate, "MODEL_ROWS", 0)
    assert sorted(map(tuple, boilerplate_lines(pages_of(spark, rows)).collect())) == plain and (1001, 3) in plain and (1000, 3) not in plain


# --- packing -----------------------------------------------------------------------------------------------------------------


def test_packing_keeps_all_text(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(120)] + ["", None, prose(rng, 3000), "漢字" * 700, "x" * 5000, texts_tie := prose(rng, 40), texts_tie]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")], "doc_id long, text string, container_id string")
    targets = spark.createDataFrame([(1, 128), (2, 512), (3, 0)], "target_id int, capacity int")
    got = pack(docs, targets).toPandas()
    for target, capacity in ((1, 128), (2, 512)):
        at = got[got["target_id"] == target]
        assert at.groupby("container_id")["n_tokens"].sum().max() <= capacity
        for i, t in enumerate(texts):
            mine = at[at["doc_id"] == i].sort_values(["part", "container_id"])
            if t is None:
                assert mine.empty
            elif i:
                assert "".join(t[a:b] for a, b in zip(mine["start_pos"], mine["end_pos"], strict=True)) == t
                assert len(mine) == 1 or mine["n_tokens"].sum() > capacity
        assert len(at[at["doc_id"] == 0]) == 2
        assert at["container_id"].nunique() <= 1.1 * at["n_tokens"].sum() / capacity + 2
    assert pack(docs.limit(0), targets).count() == 0


# --- leakage -----------------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(5, 60))) for i in range(15)] + [(90, None), (91, ""), (92, "a b c")]
    docs = []
    for d in range(80):
        w = prose(rng, 60).split()
        if d % 2:
            src = rng.choice(items[:15])[1].split()
            k = rng.randrange(len(src))
            w[20:20] = src[k : k + rng.choice((8, 11, 12, 13, 30))]
        docs.append((d, (" , ".join(w)).upper() if d % 3 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, "kaloria " * 50000), docs[1]]
    want = set()
    from skeinlake.llm.leakage import words

    for d, t in docs:
        for i, s in items:
            if t and s and any(f" {' '.join(words(s)[k : k + 12])} " in f" {' '.join(words(t))} " for k in range(len(words(s)) - 11)):
                want.add((d, i))
    dd = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame([(*x, "en") for x in items], "item_id long, text string, lang string")
    got = leaks(dd, ii)
    assert {(r["doc_id"], r["item_id"]) for r in got.where("run_words >= 12").collect()} == want and want
    assert leaks(dd.limit(0), ii).count() == 0 and leaks(dd, ii.limit(0)).count() == 0


def test_alignment_scores():
    item = "a b c d e f g h i j k l m n".split()
    assert align(item, ["x", *item, "y"])[2:] == (14, 1.0)
    longest, score, matched, identity = align(item, [*item[:6], "z", "z", *item[6:]])
    assert longest == 8 and matched == 14 and identity == (14 * 6 - 4) / (14 * 6) and score == 14 * 6 - 4
    assert align(item, [*item[:6], "z", *item[7:]])[2] == 13
    assert align(item, item[:11]) == (11, 0.0, 0, 0.0) and align([], ["a"]) == (0, 0.0, 0, 0.0) and align(item, []) == (0, 0.0, 0, 0.0)
    # usual words count little: a template with other names in it is no copy
    weight = {w: 12.0 if w in "adgjm" else 0.5 for w in item}
    assert align(item, [w if w not in "adgjm" else w * 2 for w in item for _ in (0,)], weight)[2] == 0
    assert align("a b c".split(), "b c a b".split())[0] == 2


def test_edited_copies_are_found(spark, monkeypatch):
    """Copies with a word changed, left out or put in after every five to eight, among texts that share phrases only."""
    from skeinlake.llm import leakage

    rng = random.Random(19)
    stock = [prose(rng, 7) for _ in range(6)]
    make = lambda n: " ".join(rng.choice(stock) if k % 2 and rng.random() < 0.6 else prose(rng, 6) for k in range(n // 6))
    items = [(i, make(60)) for i in range(20)]
    docs, want = [], set()
    for d in range(160):
        w = make(120).split()
        if d % 4 == 0:
            i = rng.randrange(20)
            copy, out, left = items[i][1].split(), [], rng.randrange(5, 9)
            for x in copy:
                left -= 1
                if left:
                    out.append(x)
                    continue
                left = rng.randrange(5, 9)
                out += rng.choice(([], [rng.choice(WORDS)], [x, rng.choice(WORDS)]))
            w[30:30] = out
            want.add((d, i))
        docs.append((d, " ".join(w)))
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks(dd, ii).collect()}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found)
    monkeypatch.setattr(leakage, "SEED_ROWS", 500)  # several passes give the same
    assert {(r["doc_id"], r["item_id"]) for r in leaks(dd, ii).collect()} == found


# --- sentences ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "want"), [
    ("Dr. Kalo moved 3.5 files to approx. 9 sites. St. Rin holds maps, etc. from there. It closed at 9.30 a.m. The end", ["Dr. Kalo moved 3.5 files to approx. 9 sites.", "St. Rin holds maps, etc. from there.", "It closed at 9.30 a.m.", "The end"]),
    ("“We split it. It was late,” wrote Kalo. “Is it empty?” asked Rin.", ["“We split it. It was late,” wrote Kalo.", "“Is it empty?” asked Rin."]),
    ("Prof. Kalo kam am 12. März um 9.30 Uhr. „Alles ist gut. Ja“, schrieb Rin.", ["Prof. Kalo kam am 12. März um 9.30 Uhr.", "„Alles ist gut. Ja“, schrieb Rin."]),
    ("「もう保存した。心配ない。」とKaloは書いた。棚は空だ！", ["「もう保存した。心配ない。」とKaloは書いた。", "棚は空だ！"]), ("小的校刊。“目录比较了吗？”Kalo问道。已移动……“书库？”", ["小的校刊。", "“目录比较了吗？”Kalo问道。", "已移动……", "“书库？”"]),
    ("“签名检查了吗？”Kalo问道。文件data-5.gz已保存……没有人知道。", ["“签名检查了吗？”Kalo问道。", "文件data-5.gz已保存……", "没有人知道。"]),
    ("Heading\n\n- one\n* two\n• three\n\nA line that\nwraps here. Next.", ["Heading", "- one", "* two", "• three", "A line that\nwraps here.", "Next."]),
    ("मिले। कितना नया पत्र!", ["मिले।", "कितना नया पत्र!"]), ("Πού βρίσκεται; Εδώ.", ["Πού βρίσκεται;", "Εδώ."]), ("แฟ้มอยู่ที่ไหน ไม่มีใครย้าย 3 ชิ้น", ["แฟ้มอยู่ที่ไหน", "ไม่มีใครย้าย 3 ชิ้น"]),
    ("В 2021 г. том был издан. «Где том?» — спросил Kalo.Как пишет Rin, нет.", ["В 2021 г. том был издан.", "«Где том?» — спросил Kalo.", "Как пишет Rin, нет."]), ("", []), (" \n\t ", []),
    ("El Sr. Kalo y la Dra. Rin leen aprox. 9 págs. Nada más.", ["El Sr. Kalo y la Dra. Rin leen aprox. 9 págs. Nada más."]), ("El Sr. Kalo lee. ¿Qué? Nada.", ["El Sr. Kalo lee.", "¿Qué?", "Nada."]),
    ("(The path was closed by Kalo.) It was late.", ["(The path was closed by Kalo.)", "It was late."]), ("أين فهرس؟ قال د. Kalo ذلك.", ["أين فهرس؟", "قال د. Kalo ذلك."]),
])
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentence_spans(text)] == want


def _fitted(texts):
    from collections import Counter

    from skeinlake.llm import sentences as S

    met, lengths = [Counter() for _ in range(S.KINDS)], np.zeros(S.LENGTHS)
    for t in texts:
        S.observe(t, met, lengths)
    counts = np.zeros((S.KINDS, S.SLOTS), np.float32)
    for kind, words in enumerate(met):
        for w, n in words.items():
            counts[kind, S._slot(w)] += n
    return S.SpanModel(counts, lengths)


def test_sentence_words_are_learned():
    """An opening word in small letters, an abbreviation of no list, and a closing word of few letters."""
    corpus = [f"tooly v{n} sorted box {n}.\n\nThe Zk. Lumen {n} came, it saw tooly not.\n\nThen Zk. Marin {n} went past so long ago." for n in range(40)]
    text = "What a box! tooly v2 sorted it. There Zk. Bodo was. That was ago.Then it ended."
    want = ["What a box!", "tooly v2 sorted it.", "There Zk. Bodo was.", "That was ago.", "Then it ended."]
    model = _fitted(corpus)
    assert [text[a:b] for a, b in sentence_spans(text, model)] == want
    assert [text[a:b] for a, b in sentence_spans(text)] != want


def test_sentence_division_is_the_best_of_all():
    """The dynamic programming against every division, with cuts that only the lengths of their spans decide."""
    from itertools import combinations

    from skeinlake.llm import sentences as S

    rng, model, joint = random.Random(4), S.SpanModel(), 0
    for _ in range(60):
        n = rng.randrange(2, 9)
        at = sorted(rng.sample(range(1, 900), n))
        text = "x" * 900
        cuts = {p: rng.uniform(-2, 2) for p in at}
        value = lambda ends: sum(cuts[p] for p in ends) + sum(model.length(b - a, True) for a, b in zip((0, *ends), (*ends, 900), strict=True))
        best = max((c for k in range(n + 1) for c in combinations(at, k)), key=value)
        got = [b for _, b in S._divide(text, 0, 900, cuts, set(), model)][:-1]
        assert abs(value(tuple(got)) - value(best)) < 1e-9
        joint += list(best) != [p for p in at if cuts[p] > 0]
    assert joint > 10
    far = S._best("x" * 20000, list(range(0, 20001, 10)), dict.fromkeys(range(0, 20001, 10), 0.3), model)
    assert far[0] == 0 and far[-1] == 20000


def test_sentences_cover_all_text(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("ab .!?“”\n\r(),。」Äж") for _ in range(rng.randrange(200))) for _ in range(200)] + [None, "", "x" * 200000, "word " * 30000 + ".", "(" * 3000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, start_pos int")
    by = {}
    for r in sentences(docs).collect():
        by.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    for i, t in enumerate(texts):
        spans = sorted(by.get(i, []))
        assert "".join("".join(t[a:b] for a, b in spans).split()) == "".join((t or "").split())
        assert all(not t[a].isspace() and not t[b - 1].isspace() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert sentences(docs.limit(0)).count() == 0


def test_residue_by_public_exemplars_on_held_out_text(spark):
    """Messages that are in no list of exemplars word for word, and texts that write about such things."""
    from skeinlake.llm.residue import EXEMPLARS, PASSAGES, Exemplars

    residue = [
        "404 Not Found\nnginx", "Error 503 Service Unavailable\nVarnish cache server", "HTTP Status 500 – Internal Server Error", "The requested URL /a/b.html was not found on this server. Apache Server at kalo.example Port 80",
        "You do not have permission to access /admin on this server", "Warning: include(header.php): failed to open stream: No such file or directory in /srv/www/index.php on line 12", "You need to enable JavaScript to run this app.",
        "Please enable JavaScript to view the comments.", "Dolor sit amet lorem, consectetur ipsum adipiscing sed elit tempor.", "Ut enim minim veniam quis nostrud exercitation laboris nisi aliquip", "Welcome, {{ user.name }}!", "Dear ${customer}, thank you",
        "Total: <%= order.total %>", "Seite nicht gefunden | Kalo", "Página no encontrada", "Страница не найдена", "Bitte aktivieren Sie JavaScript, um den Inhalt zu nutzen.", "Kalo Shop: Content coming soon.",
    ]
    content = [
        "The clerk explained that a page not found on the first day was found again later, and that the requested papers were on this table.", "Our lesson shows how the server answers when nothing is there, with a number and a short text.",
        "In HTML the script element can be left out; readers without scripts still get the text of our page.", "The typesetter prefers a Latin passage of no meaning for samples of type.", "Access to the reading room was denied to nobody.",
        "Prices rose by 503 units while the service was open.", "Write `{{ name }}` where the name should go.", "A short walk along the harbour and back to the archive.", "Der Dienst war am Montag nicht erreichbar, die Seite fehlte im Band.",
        "Under the new roof construction began in May.", "The index of prices is kept by the office.", "Set $HOME before you run it.",
    ]
    rows = [(i, "u", None, t) for i, t in enumerate(residue + content)] + [(1000 + i, "u", None, prose(random.Random(i), 60)) for i in range(200)]
    found = {r["id"] for r in residue_fields(pages_of(spark, rows), exemplars=Exemplars((EXEMPLARS,), PASSAGES)).collect()}
    assert len([i for i in found if i < len(residue)]) >= 0.9 * len(residue)
    assert len([i for i in found if i >= len(residue)]) <= 1
