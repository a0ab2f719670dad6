"""Quality rules, licence scans and HTML rendering against plain versions and fixtures."""

import random
import re
import time
from collections import Counter

import numpy as np

from capturelake.llm import html_text, license_scan, quality_rules, simhash, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def texts():
    rng = random.Random(3)
    words = ["die", "É", "a b", "und#", "<x>", "of", "tion.", "\x1fq"]
    out = [None, "", " \n\t", "one", "a b c d e a b c d e", "x\n\nx\nx \nx"]
    out += [rng.choice([" ", "\n", "\r\n"]).join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)]
    return out + ["go on " * 40_000]


def test_counts_equal_plain_ones(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "true AS kept", "'z' AS cleaned")
    got = {r[0]: r for r in quality_rules.quality_rules(df, ["doc_id"]).collect()}
    for i, t in rows:
        assert tuple(got[i])[1:7] == plain_quality(t)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert quality_rules.quality_rules(df.limit(0), ["doc_id"]).count() == 0


def test_lines_go_and_clean_documents_stay_as_they_are(spark):
    clean = "This is a line of prose with more than ten words in it.\nAnd here follows another one that says something else."
    menu = "Home | News | Sport | Shop | Contact"
    rows = [(1, clean, 7), (2, menu + "\n" + clean, 0), (3, menu + "\n" + "BUY!! NOW!! AND!! HERE!! AND!! NOW!!\n" * 1 + "A line of few words that is fine.", 0),
            (4, "All rights reserved.\n" + clean, 0), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").selectExpr("*", "1 AS kept", "2 AS __text")
    got = {r["doc_id"]: r for r in quality_rules.clean_documents(df).collect()}
    assert sorted(got) == [1, 2, 4]
    assert (got[1]["text"], got[1]["n_chars"]) == (clean, 7)
    assert (got[2]["text"], got[2]["n_chars"]) == (clean, len(clean)) and got[4]["text"] == clean
    assert quality_rules.clean_documents(df).columns == df.columns


def test_line_faults():
    fault = quality_rules.line_fault
    assert fault("eins | zwei | drei | vier") == "navigation"
    assert fault("this### that*** other%%% more$$$") == "symbols"
    assert fault("THE BIG LETTERS SHOUT AT YOU") == "shouting"
    assert fault("very very good good things things are are here here") == "stutter"
    assert fault("Read more") == "boilerplate" and fault("Next") == "fragment"
    assert fault("Nothing wrong with a short line.") is None


def plain_base(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    found = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words))
             if words[i:i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(
        sorted({x for _, x in found}))


def test_licence_phrases_equal_plain_search(spark):
    rng = random.Random(5)
    parts = ["CC", "BY", "cc-by", "GNU", "General", "Public", "License", "all", "Rights", "reserved", "x", "É", "\n", "the", "4.0", "under", "cc by"]
    rows = [(0, None), (1, ""), (2, "cc by" * 3)] + [(i, " ".join(rng.choices(parts, k=rng.randint(1, 60)))) for i in range(3, 300)]
    rows += [(1, "repeat"), (None, "all rights reserved"), (400, "all rights reserved " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "2 AS spans")
    got = license_scan.license_labels(license_scan.scan_licenses(df, ["doc_id"]), ["doc_id"]).collect()
    assert sorted((str(r[0]), *map(str, r[1:6])) for r in got) == sorted((str(i), *map(str, plain_base(t))) for i, t in rows)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(df.limit(0), ["doc_id"]).count() == 0


def test_licence_templates_are_covered_in_part():
    scanner = license_scan._scanner(license_scan.TEMPLATES, tuple(license_scan.PHRASES.items()))
    text = "x y Permission is hereby granted, free of charge, to any PERSON obtaining one copy of this software and associated documentation files z"
    _, matches = scanner.scan(license_scan.tokens(text.encode()))
    best = max(scanner.chains(matches), key=lambda c: c[3])
    assert scanner.labels[best[0]] == "mit" and (best[1], best[2]) == (2, 22) and 0.9 < best[3] < 1


def test_matching_statistics_equal_brute_force():
    rng = random.Random(6)
    texts_ = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = license_scan.Automaton(texts_)
    held = {tuple(t[i:j]) for t in texts_ for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    places = automaton.places(1)
    for _ in range(200):
        read, state, size = [], 0, 0
        for _ in range(25):
            read.append(rng.randrange(4))
            state, size = automaton.step(state, size, read[-1])
            want = max((k for k in range(1, len(read) + 1) if tuple(read[-k:]) in held), default=0)
            assert size == want
            if size:
                assert sorted(places[state]) == sorted(
                    (n, e) for n, t in enumerate(texts_) for e in range(size, len(t) + 1) if t[e - size:e] == read[-size:])


PAGE = """<html><head><title>T &amp; x</title><style>.no{display:none} #n , i{visibility: hidden}</style><body>Hi <b>there</b><p>one<p>two <span class="a no">gone</span>
<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><table><caption>Cap<tr><th>Name<th>Value<tr><td>long cell here<td>1<tr><td rowspan=2>r<td>2<tr><td>3</table>
<pre>  a
   b</pre>end<br>line<div hidden>gone</div><blockquote>q<p>r</blockquote><!-- gone --><script>var a="</p>"</script><i>gone</i><a href='x>y'>link</a> 5 < 6 &amp; 7</p></table></b>"""
RENDERED = """Hi there

one

two

- a
- b
  3. x
  4. y

Cap
Name            Value
long cell here  1
r               2
                3

  a
   b

end
line

    q

    r

link 5 < 6 & 7"""


def test_rendering(spark):
    assert html_text.render(PAGE) == ("T & x", RENDERED, 1)
    deep = "<div>" * 20_000 + "deep" + "<p>" * 5
    odd = ["", "<", "a<b", "<!--", "<script>x", "<p", "</p></td></table>x", "<td>x<tr><td>y", "<li>x</ol>", "<a b='c", "&#xD800;&nope;", deep]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([None, *odd, PAGE, PAGE])], "page_id bigint, html string").selectExpr("*", "1 AS title", "2 AS text")
    got = {r[0]: r for r in html_text.extract_text(df, ["page_id"]).collect()}
    assert len(got) == len(odd) + 3 and got[0]["text"] == "" and got[len(odd)]["text"] == "deep"
    assert got[3]["text"] == "a<b" and got[len(odd) + 1]["text"] == RENDERED
    assert html_text.extract_text(df.limit(0), ["page_id"]).count() == 0


def _random_page(rng, depth=0):
    """Markup and its lines, made together: blocks hold lines of their own, inline elements join the line around them."""
    markup, lines, line = "", [], ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["word", "word", "b", "div", "hidden", "unseen", "svg"])
        word = f"w{rng.randint(0, 999)} "
        if kind == "word":
            markup, line = markup + word, line + word
        elif kind == "b":
            markup, line = markup + f"<b>{word}</b>", line + word
        elif kind == "hidden":
            markup += rng.choice(["<i hidden>no</i>", "<i style='display: none'>no</i>", "<i class=gone>no</i>", "<script>no</script>"])
        elif kind == "unseen":
            markup, line = markup + f"<i class=pale>no <u style='visibility:visible'>{word}</u>no</i>", line + word
        elif kind == "svg":
            markup, line = markup + f"<svg><desc>no</desc><g>{word}</g></svg>", line + word
        elif depth < 4:
            inner, below = _random_page(rng, depth + 1)
            markup += f"<div>{inner}</div>"
            lines += [line, *below]
            line = ""
    return markup, [*lines, line]


def test_rendering_of_random_pages():
    rng = random.Random(5)
    styles = "<style>@media print{b,div{display:none}} .gone{display:none} .pale{visibility:hidden}</style><style media=print>b{display:none}</style>"
    for _ in range(300):
        markup, lines = _random_page(rng)
        assert html_text.render(styles + markup)[1] == "\n".join(x.strip() for x in lines if x.strip())


def test_visibility_by_cascade_and_foreign_elements():
    def render(page):
        return html_text.render(page)[1]

    assert render("<style>.x{display:none} p.x{display:block}</style><p class=x>shown<b class=x>gone") == "shown"
    assert render("<style>#a{visibility:hidden}</style><div id=a>no<p style='visibility:visible'>yes</div>") == "yes"
    assert render("<style>@media (max-width: 600px){b{display:none}}@media screen{i{display:none}}</style><b>wide</b><i>no</i>") == "wide"
    assert render("<svg><title>no</title><text>a</text><text>b</text></svg>") == "a\nb"
    assert render("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math>") == "x="
    assert render("<object data=f>instead</object>") == "instead"
    assert render('one <a "> two "') == "one two \""
    assert render("one <a href=") == "one <a href="


def test_hostile_pages_take_linear_time_and_room():
    n = 40_000
    pages = ["<div>x" * n, "<span></b>" * n, "<a " * n, '<a ">"' * n, "<blockquote>x" * n, "<table><tr>" + "<td colspan=1000>x" * n,
             "<table><tr>" + "<td rowspan=60000>word" * 300 + "<tr><td>x" * n, "<table><tr><td>x" * n, "<style>" + "a" * n * 6,
             "<ul><li>x" * n, "<style>" + "@media{" * n, "<p></i>" * n]
    for page in pages:
        start = time.perf_counter()
        text = html_text.render(page)[1]
        assert time.perf_counter() - start < 15 and len(text) <= 60 * len(page)
        assert text.count("x") == (page.count("x") if "<style>" not in page else 0)


def test_url_levels_deal_their_rows_few_times(spark):
    """Each level of the tree is a few shuffles: with many partitions, tasks and their files would else fill the disk."""
    rows = [(i, f"https://h{i % 3}.net/{'es' if i % 2 else 'de'}/a{i % 7}/b{i % 5}/{i}") for i in range(200)]
    spark.sparkContext.setJobGroup("url-levels", "levels")
    judged = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("url-levels")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(judged) == 200 and all(r.verdict == "block" for r in judged if "/es/" in r.path)
    assert len(jobs) <= 45


def test_quick_line_counts_are_exact():
    """Counts by bytes agree with those by characters, beyond ASCII too."""
    rng = random.Random(3)
    for _ in range(3_000):
        line = "".join(rng.choice("aBCDEÉéßΣσǅ日 #!?|»·*=\\") for _ in range(rng.randint(1, 60)))
        raw = line.encode()
        assert quality_rules._shouts(line, raw) == (sum(c.isupper() for c in line) > 4 * sum(c.islower() for c in line))
        assert quality_rules._count(raw, quality_rules.NOISE_MARKS) >= len(quality_rules.NOISE.findall(line))
        text = line.encode()
        assert simhash.word_hashes(text).tolist() == np.unique(simhash.shingle_hashes(text, 1)).tolist()
