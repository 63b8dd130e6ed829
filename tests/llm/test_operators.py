"""The training-data operators against brute force, on small fixtures and on the smallest tables."""

import hashlib
import random
import re
import textwrap
import zlib
from itertools import combinations

import numpy as np
import pytest

from brindle.llm import decontaminate as dc
from brindle.llm import html_text, language_id, licenses, packing, pii, quality, warc_audit
from brindle.llm.jaccard_join import ngram_jaccard_join
from brindle.llm.line_dedup import line_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (5, "word"), (6, "a b c\n\nd e f " * 3000), (None, "some text here")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- PII
def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group(0).split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group(0) if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group(0)) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_pii_base_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab1.@+- 9()4\U0001f600_\x01") for _ in range(60))) for i in range(400)]
    rows += [(1000, "a@b.c_d@e.f x@y.z."), (1001, "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255"), (1002, "\U0001f600 4111 1111 1111 1111 +1 (555) 123-4567"), (1003, None), (1004, "")]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        spans = base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert got[i].n_email == sum(k == "email" for k, *_ in spans)


def test_pii_learns_from_contexts(spark):
    rows = [(i, f"please call home +1 555 123 {1000 + i} today") for i in range(8)] + [(50, "please call home 555-987-6543 today"), (51, "version 2024-1234 of it")]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    assert got[50].spans == "phone:17:29" and got[50].n_phone == 0 and got[50].n_learned == 1
    assert got[51].spans == ""


def test_pii_learns_more_kinds_and_contexts(spark):
    rng = random.Random(12)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 6)) + "a1b2c3"
    rows = [(i, f'set api_key = "{key(32)}" here') for i in range(12)] + [(30, f"set api_key = {key(20)} here"), (31, f"commit {key(20)} now")]
    rows += [(100 + i, f"write to user{i}@mail.example for help") for i in range(12)] + [(130, "write to jane(at)mail.example for help"), (131, "look at(at)random")]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    assert all(got[i].n_secret == 1 and got[i].n_spans == 1 for i in [*range(12), 30]) and got[31].n_spans == 0
    assert got[30].spans == "secret:14:34" and got[130].spans == "email:9:29" and got[130].n_email == 0 and got[131].spans == ""


def test_pii_odd_rows(spark):
    assert len(pii.find_pii(docs(spark, ODD)).collect()) == len(ODD)
    assert pii.find_pii(docs(spark, [])).collect() == []


# -- Jaccard join
def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_join_matches_brute_force(spark, width, percent):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    seed = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(60):  # a large group around the threshold
        own = list(seed)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(150)] = f"x{rng.randrange(999)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 9)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, "A b C"), (203, "a B c"), (204, "a b c d")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs(spark, rows), width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_join_links_across_a_frequent_line(spark):
    rng, line = random.Random(8), " ".join(f"b{k}" for k in range(12))
    rows = [(k, f"{line} " + " ".join(f"f{k}w{j}" for j in range(20))) for k in range(20)]  # makes the line frequent
    for g in range(8):
        text = " ".join(f"g{g}w{rng.randrange(10**6)}" for _ in range(300))
        rows += [(100 + 2 * g, text), (101 + 2 * g, f"{text} {line}")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs(spark, rows), 5, 80).collect()}
    assert got == brute_components(rows, 5, 80)


def test_jaccard_join_finds_copies_with_appended_text(spark):
    rows = []
    for g in range(12):  # copies make a group's shingles frequent, so that the new ones fill the longer text's prefix
        text = " ".join(f"g{g}w{k}" for k in range(404))
        rows += [(100 * g + k, text) for k in range(9)] + [(100 * g + 50, text + "".join(f" n{g}x{k}" for k in range(28 + 4 * g)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs(spark, rows), 5, 80).collect()}
    assert got == brute_components(rows, 5, 80)


def test_jaccard_join_on_tables(spark):
    rows = [tuple(r) for r in real(spark).collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(real(spark), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_jaccard_join_odd_rows(spark):
    got = ngram_jaccard_join(docs(spark, ODD)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, None: None}
    assert ngram_jaccard_join(docs(spark, [])).collect() == []


def test_jaccard_join_counts_rows_of_one_id_apart(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, "quite another text " * 9), (7, text), (None, text), (2**60 + 1, text + " more")]
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id, r.n_shingles) for r in ngram_jaccard_join(docs(spark, rows), 5, 80).collect()), key=str)
    assert {(i, c) for _, i, c, n in got if n > 20} == {(1, 1), (7, 1), (None, 1), (2**60 + 1, 1)} and len(got) == 5
    assert [c for _, i, c, n in got if n < 20] == [1]


# -- HTML
PAGE = "<html><head><title>t</title></head><body><div>{nav}</div><nav><a>Home</a></nav><article><h1>Head &amp; tail</h1><p>One <b>two<br>three<p>four</article><div class='comments'><p>nice!</p></div><footer>f</footer></body></html>"


def test_html_templates_go(spark):
    rows = [(i, f"http://a.example/{i}", f"<html><body><div>Same on all pages</div><p>Own text number {i} goes on for quite a while, longer than the rest</p><script>x='</p>'</script></body></html>") for i in range(12)]
    rows += [(20, "http://b.example/", PAGE.format(nav="x")), (21, None, None), (22, "odd", ""), (23, "http://b.example/2", "<article><p>cut off &am"), (24, "http://b.example/3", "<p>a</p><p>b <i")]
    got = {r.page_id: r for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"Own text number {i} goes on for quite a while, longer than the rest" for i in range(12))
    assert got[20].text == "Head & tail\n\nOne two three\n\nfour"
    assert got[21].text == got[22].text == "" and got[23].text == "cut off &am" and got[24].text == "a\n\nb"
    assert got[20].n_chars == len(got[20].text)
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_templates_decide_where_nothing_is_marked(spark):
    """Without article, nav or class, what recurs on the host goes and what doesn't stays."""
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    menus, ends = [f"<div><ul><li>m{k}<li>n{k}</ul></div>" for k in range(3)], [f"<div>all rights kept {k}</div>" for k in range(3)]
    want, rows = {}, []
    for i in range(60):
        parts = [text(30), text(12)]
        want[i] = "\n\n".join(parts)
        rows.append((i, f"http://site.example/{i}", f"<html><body>{menus[i % 3]}<div><p>{parts[0]}<p>{parts[1]}</div>{ends[i % 3]}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_main_text(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_template == 3 for r in got.values())
    alone = {r.page_id: r for r in html_text.extract_main_text(pages.limit(1)).collect()}
    assert all(r.text != want[i] and r.n_template == 0 for i, r in alone.items())


def test_html_reads_odd_trees():
    read = lambda h: html_text.read_page(h)[0]
    deep = "<article>" + "<span>" * 3000 + "in it</article>after"
    blocks, kinds, _ = html_text.read_page(deep)
    assert list(zip(blocks, kinds)) == [("in it", html_text.ARTICLE), ("after", html_text.PLAIN)]
    assert read("<div>" * 5000 + "x" + "</div>" * 5000 + "y") == ["x", "y"]
    assert read("<p>a <b>b<p>c</b> d") == ["a b", "c d"] and read("<ul><li>1<li>2</ul>3") == ["1", "2", "3"]
    assert read("<table><tr><td>1<td>2<tr><td>3</table>") == ["1 2", "3"]
    kept = html_text.read_page("<article><p id='related'>a<div class='share'>b</div><div class='ad'>c</div><h2 id='comments'>d</h2></article>")
    assert [t for t, k in zip(*kept[:2]) if k == html_text.ARTICLE] == ["a", "b", "d"]


def test_html_odd_rows(spark):
    page = "<article><p>" + "word " * 200_000 + "</article>"
    rows = [(2**60 + 1, "http://a.example/", page, "x"), (None, None, None, None), (2**60 + 3, "?", "", "y"), (2**60 + 3, "?", "", "y")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([(str(2**60 + 1), 999_999), ("None", 0), (str(2**60 + 3), 0), (str(2**60 + 3), 0)])


# -- licences
def test_license_windows(spark):
    known = dict(licenses.templates())
    scanner = licenses.Scanner()
    best = lambda t: {k for k, v in scanner.scan(t).items() if v[4]}
    assert best("The photographs on this page were taken last summer and this work is licensed under CC BY 4.0.") == {"CC-BY-4.0"}
    wrap = lambda t: "\n".join(textwrap.wrap(t, 72))
    assert best(wrap(known["MIT"]) + "\n" + wrap(known["BSD-3-Clause"])) == {"MIT", "BSD-3-Clause"}
    assert best("Licensed under the MIT License " + "x " * 100) == {"MIT"}
    rng = random.Random(6)
    for k, t in known.items():  # a text with some words changed, in prose
        w = licenses.words_of(t)
        if len(w) > 40:
            w = [x if rng.random() > 0.03 else "changed" for x in w]
            assert k in scanner.scan("before it all " * 30 + " ".join(w) + " and after it " * 30), k
    rows = [(2**60 + 1, "Released under the ISC License."), (None, "Released under the ISC License."), (2**60 + 3, "x")] * 2
    got = licenses.license_scan(docs(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["None", str(2**60 + 1)] * 2)
    assert licenses.license_scan(docs(spark, [])).collect() == []


def test_license_windows_of_long_texts():
    """A passage is found alike however often the text holds it: each of its windows is compared, few or many."""
    scanner = licenses.Scanner()
    known = dict(licenses.templates())
    rng = random.Random(1)
    for name in ("MPL-2.0", "Zlib", "ISC", "MIT", "CC-BY-4.0"):
        for _ in range(6):
            block = " ".join(rng.choice(["changed", x + " " + x]) if rng.random() < 0.16 else x for x in licenses.words_of(known[name]))
            texts = [block + "".join(f" z{k}x{i}" for i in range(400)) for k in range(40)]  # apart, and no two gaps alike
            one, many = scanner.scan(texts[0]), scanner.scan(" ".join(texts))
            assert {k: (v[0], v[3] * 40) for k, v in one.items()} == {k: (v[0], v[3]) for k, v in many.items()}


def test_license_scan(spark):
    mit = dict(licenses.templates())["MIT"]
    rows = [(1, "some words\nLicensed under CC BY-NC 4.0.\nmore"), (2, "text\n" + mit.replace(". ", ".\n") + "\nmore"), (3, "Licensed under the sun."), (4, None), (5, ""), (6, "x " * 50000)]
    got = {(r.doc_id, r.license): r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert got[1, "CC-BY-NC-4.0"].dice == 1.0 and got[1, "CC-BY-NC-4.0"].first_line == 1
    assert got[2, "MIT"].dice > 0.95 and {k[0] for k in got} == {1, 2}
    scanner = licenses.Scanner()
    for r in real(spark).collect():  # every line against every template
        want = {}
        for line in r.text.split("\n"):
            w = licenses.words_of(line)
            own = set(zip(w, w[1:]))
            for name, text in licenses.templates():
                t = licenses.words_of(text)
                t = set(zip(t, t[1:]))
                d = 2 * len(own & t) / (len(own) + len(t)) if own else 0
                if d >= licenses.THRESHOLD:
                    want[name] = max(d, want.get(name, 0))
        assert {k: v[0] for k, v in scanner.scan(r.text).items()} == pytest.approx(want)


# -- WARC
def test_fixity_audit_locates_damage(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * (i * 37 % 5000)) for i in range(2500)] + [(None, None, None)], "page_id long, url string, html string")
    a = warc_audit.warc_records(pages)
    rows = sorted(a.collect(), key=lambda r: (r.archive, r.offset))
    assert [r.offset for r in rows if r.archive == 1][:2] == [0, next(r.length for r in rows if r.archive == 1)]
    assert warc_audit.fixity_audit(a, a).collect() == []
    b = a.filter(f"NOT (archive = {rows[700].archive} AND offset = {rows[700].offset})")
    hit = rows[1500]
    b = b.selectExpr("archive", "offset", "length", f"IF(archive = {hit.archive} AND offset = {hit.offset}, 'bad', digest) AS digest")
    got = {(r.archive, r.offset): r.status for r in warc_audit.fixity_audit(a, b).collect()}
    assert got == {(rows[700].archive, rows[700].offset): "missing", (hit.archive, hit.offset): "corrupt"}


# -- decontamination
def test_decontamination_finds_verbatim_and_reparameterised(spark):
    item = "A train leaves the station at 60 km per hour and then stops after 45 minutes near the old bridge of Anna"
    same = item.replace("60", "80").replace("45", "30").replace("Anna", "Maria")
    mixed = "At 5 apples and 5 pears for 3 people the cook makes 5 cakes out of 5 bowls with 3 spoons"
    clash = mixed.replace("5 pears", "7 pears").replace("3 spoons", "9 spoons")
    bench = spark.createDataFrame([(1, item), (2, "short item of six words here"), (3, None), (4, "two words"), (5, mixed)], "item_id long, text string")
    rows = [(1, f"before it. {item} after it"), (2, f"other words {same} and so on"), (3, "nothing to see " * 40), (4, None), (5, ""), (6, "x short item of six words here y"), (7, f"see {clash}")]
    got = {(r.doc_id, r.item_id): r for r in dc.decontaminate(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2)}
    assert got[2, 1].n_changed == 3 and got[1, 1].n_changed == 0
    assert dc.decontaminate(docs(spark, []), bench).collect() == []
    assert dc.decontaminate(docs(spark, rows), bench.limit(0)).collect() == []


def test_decontamination_looks_at_each_copy(spark):
    item = "A cook fills 5 jars with 7 plums and 9 figs then sells 3 of them to Anna for 8 coins"
    other = item.replace("5", "6").replace("7", "6").replace("Anna", "Maria")
    third = item.replace("9", "4").replace("3", "2")
    wide = third.replace("then sells", "then quite gladly sells")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    far = "many words in between them " * 30
    rows = [(1, f"first {item}. {far} {other}"), (2, f"so {other} {third} end"), (3, f"so {other} {far} {wide}"), (4, f"so {item} {far} he fills 6 jars with 6 plums and 4 figs"), (5, f"so {other} {far} {other}")]
    got = {r.doc_id: r for r in dc.decontaminate(docs(spark, rows), bench).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].n_changed == got[4].n_changed == 0 and got[2].n_changed == got[3].n_changed == 2


def test_decontamination_finds_items_of_slots_and_capitals(spark):
    bench = spark.createDataFrame([(1, "3 7 9 12 15 18 21 24 27 31"), (2, "Mary Anna Peter Paul Simon Andrew James John Luke"), (3, "Green ideas sleep very well"), (4, "Nine old men went down to the river"), (5, "Sum 14 and 25 36 47 58 69 now")], "item_id long, text string")
    rows = [(1, "see 3 7 9 12 15 18 21 24 27 31 there"), (2, "names Mary Anna Peter Paul Simon Andrew James John Luke follow"), (3, "in a line\nGreen ideas sleep very well"), (4, "without an end\nNine old men went down to the river and"), (5, "so Sum 14 and 25 36 47 58 70 now"), (6, "so: sum 1 and 2 3 4 5 6 now"), (7, "5 8 2 77 15 18 91 24 27 33 and Eva Ida Ada Max Tom Jim Joe Ben Ron"), (8, "then. Sum 14 and 25 36 47 58 70 now")]
    got = {(r.doc_id, r.item_id): r.n_changed for r in dc.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {(1, 1): 0, (2, 2): 0, (3, 3): 0, (4, 4): 0, (5, 5): 1, (8, 5): 1}


def test_decontamination_of_short_items_and_long_texts(spark):
    bench = spark.createDataFrame([(1, "Name three rivers"), (2, "A farmer has 12 cows and sells 5 of them at the fair")], "item_id long, text string")
    far = "many other words stand here and there " * 20_000
    rows = [(1, "x\nname three rivers.\ny"), (2, "please name three rivers now"), (3, far + "A farmer has 31 cows and sells 8 of them at the fair " + far), (4, far), (5, "A farmer has 31 cows and sells 31 of them at the fair")]
    got = {(r.doc_id, r.item_id): r.n_changed for r in dc.decontaminate(docs(spark, rows + rows), bench).collect()}
    assert got == {(1, 1): 0, (3, 2): 2}


def test_decontamination_of_parameters_matches_brute_force(spark):
    """Items with other numbers are found, and only where each value stands for one value."""
    rng = random.Random(4)
    nouns = [f"noun{k}" for k in range(400)]
    items = [(i, " ".join(f"{rng.choice(nouns)} {rng.choice(nouns)} and {rng.randrange(2, 90)}" for _ in range(6))) for i in range(15)]
    rows, want = [], set()
    for i, t in items:
        values = sorted({x for x in t.split() if x.isdigit()})
        other = dict(zip(values, rng.sample(range(100, 999), len(values))))
        same = " ".join(str(other.get(x, x)) for x in t.split())
        rows += [(10 * i, f"so {same} ends"), (10 * i + 1, " ".join(rng.choice(nouns) for _ in range(60)))]
        want.add((10 * i, i))
        if len(values) > 3:  # all values made one: no longer the item
            rows.append((10 * i + 2, " ".join("500" if x.isdigit() else x for x in t.split())))
    got = {(r.doc_id, r.item_id) for r in dc.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_decontamination_on_tables(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.decontaminate(real(spark), bench).collect()}
    bare = lambda t: [re.sub(r"^\W+|\W+$", "", w.lower()) or w for w in words(t)]
    want = {(d.doc_id, b.item_id) for b in bench.collect() for d in real(spark).collect() if f" {' '.join(bare(b.text)[1:])} " in f" {' '.join(bare(d.text))} "}
    assert want <= got


# -- lines
def brute_lines(rows, least):
    """Lines that lie in a run of ``least`` words whose like starts earlier."""
    seq = []
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        own = [(n, line) for n, line in enumerate((t or "").split("\n")) if words(line)] if t is not None else []
        seq.append((i, own))
    seen, drop = set(), {i: set() for i, _ in seq}
    for i, own in seq:
        for a in range(len(own)):
            size = 0
            for b in range(a, len(own)):
                size += len(words(own[b][1]))
                run = tuple(x[1] for x in own[a : b + 1])
                if size >= least and run in seen:
                    drop[i] |= set(range(own[a][0], own[b][0] + 1))
                seen.add(run)
    return drop


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    lines = [" ".join(f"l{k}w{j}" for j in range(rng.randrange(1, 9))) for k in range(14)] + [""]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 25)))) for i in range(60)] + [(99, None)]
    want = brute_lines(rows, 12)
    got = {r.doc_id: r for r in line_dedup(docs(spark, rows), 12).collect()}
    assert {i: set(map(int, filter(None, r.removed.split(",")))) for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]))


def test_line_dedup_odd_rows(spark):
    got = line_dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.n_removed == 0 for r in got if r.doc_id != 6)
    assert line_dedup(docs(spark, [])).collect() == []


# -- language
def test_language_id_holds_out_well(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    held = d.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    model = language_id.train(d.text[~held].tolist(), d.lang[~held].tolist())
    got = language_id.predict(d.text[held].tolist(), model)
    assert np.mean([g[0] == x for g, x in zip(got, d.lang[held])]) >= 0.95
    assert language_id.predict([None, "", "123 !", "x"], model)[:3] == [("und", 0.0)] * 3
    frame = spark.createDataFrame([(1, None, False), (2, "the of and", False)], "doc_id long, text string, held_out boolean")
    assert [r.lang_pred for r in language_id.identify_language(frame, model).orderBy("doc_id").collect()] == ["und", "en"]
    assert [r.lang_pred for r in language_id.identify_language(frame, None).collect()] == ["und", "und"]


def test_forward_backward_in_blocks_is_exact():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 32, 33, 100, 134])
    score, trans = rng.normal(size=(300, 3)), rng.normal(size=(3, 3))
    got, at, A = language_id.marginals(score, sizes, trans), 0, np.exp(trans)
    for n in sizes:
        E = np.exp(score[at : at + n])
        f, b = [E[0]], [np.ones(3)]
        for t in range(1, n):
            x = (f[-1] @ A) * E[t]
            f.append(x / x.sum())
        for t in range(n - 1, 0, -1):
            x = A @ (E[t] * b[0])
            b.insert(0, x / x.sum())
        want = np.array(f) * np.array(b)
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_language_words_are_letters_alone(spark):
    assert language_id.words_of("½ ² Ⅷ ①") == [] and language_id.words_of("A½b Ünd") == ["a", "b", "ünd"]
    rows = [(i, f"{w} " * 30, lang) for i, (w, lang) in enumerate([("der die und", "de"), ("the and of", "en")] * 20 + [("que para los", "es")])]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[0] == ["de", "en", "es"]  # the rare one is drawn too
    frame = spark.createDataFrame([(2**60 + 1, "½ ²", True), (None, "los que", None), (2**60 + 3, "the of " * 100_000, False)], "doc_id long, text string, held_out boolean")
    assert {(r.doc_id, r.lang_pred) for r in language_id.identify_language(frame, model).collect()} == {(2**60 + 1, "und"), (None, "es"), (2**60 + 3, "en")}
    assert language_id.fit(frame.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")) is None


# -- packing
def test_packing_lengths_are_chosen_jointly():
    rng = random.Random(1)
    lengths = sorted((rng.choice([rng.randrange(20, 240), rng.randrange(300, 900), rng.randrange(1500, 4097)]) for _ in range(400)), reverse=True)
    sizes = packing.CAPACITIES
    costs = {use: packing.best_fit(lengths, sizes, use)[3] for k in range(len(sizes)) for few in combinations(sizes[:-1], k) for use in [(*few, sizes[-1])]}
    use = packing.best_lengths(lengths)
    assert costs[use] <= min(costs.values()) * 1.005 and costs[use] < costs[(4096,)]
    bins, offsets, caps, total = packing.best_fit(lengths, sizes, use)
    assert len(set(caps)) > 1 and total == pytest.approx(sum(map(packing.cost, caps)))
    room = {}  # plain best fit by hand over all open bins, with the lengths in use
    rest, opened = sum(lengths), []
    for n, b in zip(lengths, bins):
        fit = min(((r, k) for k, r in enumerate(opened) if r >= n), default=None)
        if fit is None:
            cap = min((c for c in use if c >= n), key=lambda c: (packing.cost(c) / min(c, rest), c))
            opened.append(cap)
            fit = (cap, len(opened) - 1)
        assert fit[1] == b
        opened[b] -= n
        rest -= n
        room[b] = opened[b]


def test_packing_spreads_rows_of_one_id(spark):
    rows = [(None, "w " * 300)] * 500 + [(2**60 + 1, "w " * 5000)] + [(2**60 + 3, "w")] * 2
    got = packing.pack(docs(spark, rows), shard_pieces=100).collect()
    assert len({r.bin_id.split("-")[0] for r in got if r.doc_id is None}) > 3 and len(got) == 504
    assert sum(r.piece_len for r in got if r.doc_id == 2**60 + 1) == 5000 and sum(r.piece_len for r in got if r.doc_id == 2**60 + 3) == 2


def test_packing_is_whole_and_fits(spark):
    rows = [(i, "w " * (i * 7919 % 700)) for i in range(300)] + [(1000, "w " * 9000), (1001, None), (1002, ""), (1000, "w " * 9000)]
    got = packing.pack(docs(spark, rows), shard_pieces=200).collect()
    lengths = {}
    bins = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.piece_len
        if r.piece_len:
            bins.setdefault(r.bin_id, []).append(r)
    assert lengths == {**{i: i * 7919 % 700 for i in range(300)}, 1000: 18000, 1001: 0, 1002: 0}
    for own in bins.values():
        end, cap = 0, own[0].bin_capacity
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == end and r.bin_capacity == cap
            end += r.piece_len
        assert end <= cap and not any(c >= end for c in packing.CAPACITIES if c < cap)
    assert packing.pack(docs(spark, [])).collect() == []


# -- quality
def test_quality_counts_match_brute_force(spark):
    rows = [tuple(r) for r in real(spark).collect()] + [(10**6 + k, t) for k, (_, t) in enumerate(ODD)] + [(10**7, "a a a a b\n|#\na a a\n\n\n|#\nb"), (10**7 + 1, "a b c a b c")]
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, rows)).collect()}
    for i, t in rows:
        w, t = words(t), t or ""
        triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = {k for k in range(len(triples)) if triples.count(triples[k]) > 1} if len(w) < 2000 else None
        lines = [x for x in t.split("\n")]
        dup = sum(1 for k, x in enumerate(lines) if words(x) and x in lines[:k]) if len(lines) < 2000 else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        if many is not None and dup is not None:
            repeat = len({k + j for k in many for j in range(3)})
            assert (r.n_dup_lines, r.n_repeat_words) == (dup, repeat)
            assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_script_is_that_of_most_letters(spark):
    plain = {
        "ar": "في القديم كان الناس يعيشون قرب النهر ويزرعون القمح والشعير كل عام وكانت المدينة الكبيرة تقع خلف الجبال البعيدة حيث يبيع التجار بضائعهم",
        "he": "בימים ההם גרו אנשים רבים ליד הנהר וגידלו חיטה ושעורה בכל שנה והעיר הגדולה עמדה מאחורי ההרים הרחוקים שבהם מכרו הסוחרים את סחורתם",
        "hi": "पुराने समय में लोग नदी के पास रहते थे और हर साल गेहूँ उगाते थे बड़ा शहर दूर पहाड़ों के पीछे था जहाँ व्यापारी अपना सामान बेचते थे",
    }
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(t.split()) for _ in range(200)) + end) for k, (t, end) in enumerate((t, e) for t in plain.values() for e in ("", " https://example.org/a"))]
    rows += [(10, "the old town by the river " + "мир " * 2), (11, "123 !?")]
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, rows)).collect()}
    assert all(got[k].script == "other" and got[k].kept for k in range(6))
    assert got[10].script == "latin" and got[11].script == "other"


def test_quality_rejects_by_fitted_bands(spark):
    """Gibberish, mis-encoded and shouted texts go where a corpus shows what is usual; clean texts stay."""
    rng = random.Random(11)
    vocab = [w for r in real(spark).collect() if r.text for w in r.text.split() if w.isalpha() and w.islower()]
    clean = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(80, 300)))) for i in range(300)]
    junk = [(1000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(150))) for i in range(10)]
    junk += [(2000 + i, t.upper()) for i, t in clean[:10]] + [(3000 + i, " | ".join(t.split())) for i, t in clean[:10]]
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, clean + junk)).collect()}
    assert np.mean([got[i].kept for i, _ in clean]) > 0.98
    assert np.mean([got[i].kept for i, _ in junk]) < 0.2
    assert all(got[i].kept for i in (2000, 2001)) or not any(got[i].base_failed for i in got if i >= 2000)
    few = {r.doc_id: r.kept for r in quality.quality_rules(docs(spark, clean[:50])).collect()}  # too few for bands: the limits alone
    assert all(few.values())


def test_quality_measures_match_brute_force(spark):
    import sentencepiece

    ranks, pieces = quality.vocabulary_paths()
    fertility = quality.Fertility(ranks, pieces)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
    texts = [r.text for r in real(spark).limit(40).collect() if r.text] + ["naïve 漢字 ☃ \U0001f600 x", "ab\tcd"]
    got = quality.measure(texts, fertility)
    for k, t in enumerate(texts):
        ids = [i for w in words(t) for i in fertility.encoding.encode_ordinary(" " + w)]
        p = [ids.count(i) / len(ids) for i in set(ids)]
        assert got["n_tokens"][k] == len(ids) and got["entropy"][k] == pytest.approx(-sum(x * np.log2(x) for x in p))
        chars = [c for c in t if not c.isspace()]
        falls = [c for c in chars if any(sp.is_byte(i) for i in sp.encode(c))]
        assert got["byte_share"][k] == pytest.approx(len(falls) / len(chars))


def test_ids_beside_nulls_and_clashing_columns(spark):
    """Large ids beside a null in one partition come back as they are; extra columns of any name do no harm."""
    text = "\n".join(f"line {k} " + "w " * 12 for k in range(12))
    clash = "n_words long, kept boolean, text_ string, n_lines long, n_removed long, removed string, piece long, component_id long, kind string, h long, n long"
    rows = [(i, t, None, None, None, 5, True, "z", 6, 7, "r", 8, 9, "k", 10, 11) for i, t in ((2**60 + 1, text), (None, "x"), (2**60 + 3, text), (2**60 + 3, text))]
    frame = spark.createDataFrame(rows, f"{DOCS}, {clash}").coalesce(1)
    ids = sorted([str(2**60 + 1), "None", str(2**60 + 3), str(2**60 + 3)])
    back = lambda df: sorted(str(r.doc_id) for r in df.collect())
    assert back(quality.quality_rules(frame)) == ids and back(ngram_jaccard_join(frame)) == ids and back(packing.pack(frame)) == ids and back(pii.find_pii(frame)) == ids
    assert sorted((str(r.doc_id), r.n_removed) for r in line_dedup(frame).collect()) == sorted([("None", 0), (str(2**60 + 1), 0), (str(2**60 + 3), 12), (str(2**60 + 3), 12)])
    kept = quality.keep_documents(frame)
    assert kept.columns == frame.columns and back(kept) == []
    bench = spark.createDataFrame([(1, "line 3 " + "w " * 12)], "item_id long, text string")
    assert {str(r.doc_id) for r in dc.decontaminate(frame, bench).collect()} == {str(2**60 + 1), str(2**60 + 3)}


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    before = d.count()
    for name, stage in p.STAGES[:-1]:
        d = p.materialize(stage(spark, d, SF))
        assert d.columns == p.COLUMNS and d.count() < before, name
        before = d.count()
    out = p.STAGES[-1][1](spark, d, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in d.select("doc_id").collect()}


def test_packed_sets_keep_48_bits():
    from brindle.llm.jaccard_join import _pack_set, _unpack_set

    rng = np.random.default_rng(5)
    near = np.array([0, 1, 1 << 16, (1 << 32) - 1, 1 << 32, (1 << 64) - 1], dtype=np.uint64)
    for s in (near[:0], near[:1], near[-1:], near, *(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 7, 500, 200_000))):
        data = _pack_set(s)
        assert len(data) == 6 * len(s)
        assert np.array_equal(_unpack_set(data), s >> np.uint64(16))
