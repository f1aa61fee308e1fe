"""The text operators against brute force on small tables with every odd row."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sequora.llm import html_text, kernel, minhash_dedup, mixing, packing, pii, quality, substring_dedup, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, group string, h1 long"


def passage(n, k):
    return " ".join(f"w{(i * k) % 97}x{k}" for i in range(n))


def odd_documents():
    """Null and empty fields, ties, repeated rows, blank and very long texts, and extra columns with clashing names."""
    long = passage(30_000, 5)
    texts = [
        None, "", " \t\n\x0b ", "one", "one two three", passage(40, 7), passage(40, 7), passage(60, 3) + " end", "start " + passage(60, 3), passage(60, 3).upper(),
        long, long + " more", "a b " * 200, "a b " * 100, passage(34, 11), passage(34, 11), passage(35, 13), "x " + passage(35, 13), "é ü " + passage(50, 17) + " z", passage(50, 17),
        "mail me.x@a-b.example.org or +1 (555) 010-9999, 4111 1111 1111 1111; 10.0.0.255", "9" * 50_000, "a" * 200_000, "@" * 5000, "<|endoftext|> done", "\x07 bell \x07",
    ]
    rows = [(i, t, "en", ["s0", "s1", "s2", None][i % 4], len(t) if t else None, "k", "g", i) for i, t in enumerate(texts)]
    rows += [(None, passage(40, 7), None, None, None, None, None, None), (5, passage(40, 7), "en", "s1", 1, "k", "g", 5), (3, "another text", None, "s0", 1, None, None, 3)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# Substring dedup


def brute_removal(rows, window):
    words = [WORD.findall(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((d, len(w), keep.count(False), hashlib.sha256(" ".join(x for x, k in zip(w, keep, strict=True) if k).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_substring_dedup(spark, request, table):
    df = request.getfixturevalue(table)
    got = [tuple(r) for r in substring_dedup.remove_repeats(df, spark).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_removal(rows_of(df), 35)))


@pytest.mark.parametrize(("window", "gram"), [(5, 2), (8, 8), (3, 1)])
def test_substring_dedup_of_random_words(spark, window, gram):
    rng = np.random.default_rng(window)
    rows = [(i, " ".join(rng.choice(list("abc"), int(n)))) for i, n in enumerate(rng.integers(0, 60, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:4] for r in substring_dedup.remove_repeats(df, spark, window, gram, text=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_removal(rows, window)))


def test_leftmost_minima():
    g = np.array([5, 3, 9, 3, 1, 7, 7, 2], np.uint64) << np.uint64(40)
    assert kernel.leftmost_minima(g, 3).tolist() == [1, 1, 4, 4, 4, 7]


# MinHash


def brute_components(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    real = [i for i, (d, _) in enumerate(rows) if d is not None]
    up = {rows[i][0]: rows[i][0] for i in real}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in real:
        for j in real:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else root(d), None if d is None else root(d) == d) for (d, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("table", ["odd", "docs"])
@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, request, table, k):
    df = request.getfixturevalue(table)
    got = [tuple(r) for r in minhash_dedup.near_duplicates(df, spark, shingle=k).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows_of(df), k)))


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large group is compared in blocks, and links are kept at the threshold itself."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(43)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.choice(43, int(rng.integers(0, 4)), replace=False):
            w[j] = f"y{rng.integers(3)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash_dedup.near_duplicates(df, spark, shingle=4).collect()]
    assert sorted(got) == sorted(brute_components(rows, 4))


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * 2 * share / (1 + share))
        y = np.concatenate([x[:n], rng.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)])
        m = np.stack([minhash_dedup.minima(v) for v in (x, y)])
        assert minhash_dedup.estimates(*(minhash_dedup.packed(m[i : i + 1]) for i in (0, 1)))[0] == pytest.approx(share, abs=0.08)


def test_one_of_each(spark, odd):
    """One row of each component; rows that share an id but not a text are compared as any others."""
    rows = rows_of(odd)
    left = rows_of(minhash_dedup.one_of_each_row(odd, spark))
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    groups = defaultdict(set)
    for i, _, c, _ in brute_components(numbered, 5):
        groups[c].add(i)
    texts = {t: c for (i, t), (_, _, c, _) in zip(numbered, brute_components(numbered, 5), strict=True)}
    got = Counter(texts[t] for _, t in left if t)
    assert set(got.values()) == {1} and set(got) == {c for c, m in groups.items() if rows[c][1]}


def test_shared_ids_and_far_blocks(spark, monkeypatch):
    """Classes that share a doc_id are connected; a group of several blocks that falls apart is put together across them."""
    a, b, c = passage(60, 3), passage(60, 5), passage(60, 7)
    rows = [(5, a), (5, b), (3, a), (7, b), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:3:2] for r in minhash_dedup.near_duplicates(df, spark).collect()) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(minhash_dedup, "BUCKET_ROWS", 4)
    monkeypatch.setattr(minhash_dedup, "PIVOTS", 1)
    words = [f"w{i}" for i in range(120)]  # a chain: neighbours are alike, others are not
    chain = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(20)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), spark, shingle=2, percent=88).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(chain, 2, 88))


def test_distinct_documents_with_null_and_reused_ids(spark):
    """Different texts under one doc_id stay, near-copies go whatever their ids are, the smallest id of a component is kept."""
    a, b, c = passage(60, 3), passage(60, 5), passage(60, 7)
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (None, a + " else"), (None, c), (None, c + " end"), (None, c), (3, None), (3, ""), (None, None), (None, None), (4, "one"), (5, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = corpus_pipeline.distinct_documents(spark, df, "")
    assert got.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in got.collect())
    held = [t for d, t in got if d is None and t]
    assert len(held) == 1 and held[0] in (c, c + " end")
    del got[None, held[0]]
    assert got == Counter([(1, a), (1, b), (3, None), (3, ""), (None, None), (None, None), (4, "one")])


# Personal data

BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and pii.luhn(re.sub("[ -]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def brute_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, r, ok in BASE for m in r.finditer(t) if ok(m[0])]


@pytest.mark.parametrize(
    "text",
    ["a@b.c.d@e.f", "a@@b.c", "x%+y@z.co, .@-.-", "1.2.3.4.5.6.7.8", "001.0002.3.256 0255.1.1.1", "4111-1111 1111-1111", "4111 1111  1111 1111 41111111111111111", "+1 (555) 010-9999+2 3", "+12345678 +1234567 +1 234 567 890 123 456 7", "a" * 300 + "@b", "@a.b a@b. c", "\U0001f600 a@b.cc \U0001f600", "1" * 17 + "." * 3],
)
def test_base_spans(text):
    assert pii.joined(pii.base_spans(text)).split(",") == (brute_spans(text) or [""])


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_pii(spark, request, table):
    df = request.getfixturevalue(table)
    texts = rows_of(df)
    got = pii.digest(df, spark).collect()
    want = []
    for d, t in texts:
        spans = brute_spans(t) if len(t) < 40_000 else pii.joined(pii.base_spans(t)).split(",")
        spans = [s for s in spans if s]
        want.append((d, *(sum(s.startswith(k) for s in spans) for k in pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))
    for r in got:  # base spans are among all spans
        t = [t for d, t in texts if d == r.doc_id and len(t) < 40_000]
        assert not t or any(set(brute_spans(x)) <= set(r.spans.split(",")) for x in t)


def test_bootstrap_finds_unseen_identifiers(spark):
    """Numbers like cards, and numbers that run into each other, are found where the base patterns find nothing; other numbers are not."""

    def card(i):
        d = f"4{i:014d}"
        return next(f"{d}{c}" for c in range(10) if pii.luhn(f"{d}{c}"))

    rows = [(i, f"the card {card(i)} expires soon") for i in range(40)]
    wrong = card(77)[:-1] + str((int(card(77)[-1]) + 1) % 10)
    rows += [(100, f"my card {wrong} was lost"), (101, f"part number {wrong[:12]} of 20"), (102, "version 123456 of it")]
    rows += [(200 + i, f"call +1 (555) 010-{i:04d} now") for i in range(40)] + [(300, f"so +1 (555) 010-7777 {card(88)} it is")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()}
    assert got[100] == "card:8:24" and not got[101] and not got[102] and all(got[i] for i in range(40))
    assert got[300] == "card:21:37,phone:3:20"


def planted_identifiers():
    """Rows, and by row the unseen identifier in it or None: contexts that seeds support, forms that the base patterns miss, and distractors."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    filler = lambda n: " ".join(word() for _ in range(n))

    def card(ok=True):
        d = "4" + digits(14)
        good = next(c for c in "0123456789" if pii.luhn(d + c))
        return d + (good if ok else str((int(good) + 3) % 10))

    seen = [
        lambda: f"please write to {word()}.{word()}@{word()}.example.org today",
        lambda: f"call us at +1 (555) {digits(3)}-{digits(4)} anytime",
        lambda: f"her card {card()} expires soon",
        lambda: f"host ip {rng.integers(1, 250)}.{rng.integers(1, 250)}.{rng.integers(1, 250)}.{rng.integers(1, 250)} was logged",
    ]
    unseen = [
        lambda: ("please write to {} today", f"{word()}@{word()}", 0),
        lambda: ("please write to {} today", f"{word()}[at]{word()}.example.org", 0),
        lambda: ("call us at {} anytime", f"15551 {digits(3)} {digits(3)}", 3),
        lambda: ("call us at {} anytime", f"1555{digits(7)}", 3),
        lambda: ("her card {} expires soon", card(False), 2),
        lambda: ("host ip {} was logged", f"10.{rng.integers(10, 99)}.{rng.integers(10, 99)}.{rng.integers(300, 999)}", 1),
    ]
    other = [lambda: f"order {digits(11)} was sent", lambda: f"version {digits(2)}.{digits(2)}.{digits(2)}.{rng.integers(300, 999)} of it", lambda: f"part {digits(16)} in stock", lambda: f"meet {word()} @ {word()} at 1{digits(9)} or so", lambda: f"on 2024-0{rng.integers(1, 9)}-{rng.integers(10, 28)} it rained"]
    rows, want = [], {}
    for i in range(900):
        pick = rng.random()
        if pick < 0.5:
            body = seen[i % len(seen)]()
        elif pick < 0.65:
            form, token, kind = unseen[i % len(unseen)]()
            body = form.format(token)
        else:
            body = other[i % len(other)]()
        text = f"{filler(int(rng.integers(2, 9)))} {body} {filler(int(rng.integers(2, 9)))}"
        if 0.5 <= pick < 0.65:
            want[i] = f"{pii.KINDS[kind]}:{text.index(token)}:{text.index(token) + len(token)}"
        rows.append((i, text))
    return rows, want


def test_added_spans_are_right(spark):
    """Recall of planted identifiers that no base pattern finds, of every kind, and precision of all spans that are added."""
    rows, want = planted_identifiers()
    got = {r.doc_id: set(r.spans.split(",")) - {""} for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()}
    added = {(i, x) for i, t in rows for x in got[i] - set(brute_spans(t))}
    wanted = set(want.items())
    by_kind = {k: [w in added for w in wanted if w[1].startswith(k)] for k in pii.KINDS}
    assert all(len(v) >= 10 and np.mean(v) >= 0.9 for v in by_kind.values()), {k: (len(v), np.mean(v)) for k, v in by_kind.items()}
    assert len(added & wanted) >= 0.9 * len(added), sorted(added - wanted)[:20]


@pytest.mark.parametrize("text", ["1 " + "a" * 10**6, "1," * 300_000, "+1 " * 100_000, "1 2 " * 100_000, "a@" * 200_000, "@" * 10**6, "1.1.1." * 100_000, "+" * 10**6 + "1" * 10**6, "(at)" * 200_000, "a1" * 500_000], ids=lambda t: t[:6])
def test_long_texts_take_linear_time(text):
    start = time.process_time()
    pii.occurrences(text, pii.base_spans(text), 6, (8, 19))
    assert time.process_time() - start < 20


def test_redaction(spark, odd):
    out = pii.redact(odd, spark)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = [r.text for r in out.collect()]
    assert "mail [EMAIL] or [PHONE], [CARD]; [IP]" in texts and all(len(r.text) == r.n_chars for r in out.where("text like '%[EMAIL]%'").collect())


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two<br>three&nbsp;four</p><script>var s='</p>';</script><p>Short.</p><div class=\"ad\">Buy</div><div id=comments><p>First!</p></div></article><footer>&copy; me</footer></body></html>", "A & B\nOne two three four\nShort."),
        ("<article><p>Left open <b>here<p>and here", "Left open here\nand here"),
        ("<nav>Menu <article><p>Kept</p></article>", "Kept"),
        ("<main><p>Only <!-- not <p>this --> that</p><form><input>Name</form></main>", "Only that"),
        ("<body><div class='cookie-notice'><p>We use the cookies that are the best for you and for us and they are of the kind that you have to have in it.</p></div><h2>Head of it</h2><p>It was the best of the times and it was the worst of the times, as it is with all of them, and we had it all before us and nothing at all.</p><p>So it was.</p><ul><li><a href=a>More</a></li><li><a href=b>Other</a></li></ul></body>",
         "Head of it\nIt was the best of the times and it was the worst of the times, as it is with all of them, and we had it all before us and nothing at all.\nSo it was."),
        ("<article><p title='a > b'>x &lt; y &#233;&#x1F600;</p></article>", "x < y é\U0001f600"),
        ("<article><header><h1>Own head</h1></header><p>Text</p><aside>Side</aside><section class='related-posts'><p>Else</p></section></article>", "Own head\nText"),
        ("<article><p>" + "word " * 50_000 + "</p></article>", ("word " * 50_000).strip()),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


BODY = "It was the best of the times and it was the worst of the times, as it is with all of them, and we had it all before us and nothing at all."
LINKS = "<ul><li><a href=a>Some other page of theirs</a></li><li><a href=b>And one more of them</a></li></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        # articles that are only teasers; the text is outside
        (f"<body><div><h1>Head</h1><p>{BODY}</p><p>{BODY}</p></div>" + "<article><h2><a href=x>Elsewhere</a></h2><a href=x>Read it</a></article>" * 3 + "</body>", f"Head\n{BODY}\n{BODY}"),
        # a linked heading goes with the text after it
        (f"<article><h1><a href=x>Head</a></h1><p>{BODY}</p>{LINKS}<h2><a href=y>Elsewhere</a></h2>{LINKS}</article>", f"Head\n{BODY}"),
        ("<article><h1><a href=x>Head</a></h1><p>Short.</p></article>", "Head\nShort."),
        # the rules decide inside an article as well as outside it
        (f"<article><p>{BODY}</p>{LINKS}<p>Tags: this, that</p>{LINKS}<p>{BODY}</p></article>", f"{BODY}\n{BODY}"),
        (f"<article>{LINKS}<p>{'slovo ' * 30}</p><p>{'drugo ' * 30}</p>{LINKS}</article>", f"{('slovo ' * 30).strip()}\n{('drugo ' * 30).strip()}"),
        (f"<article><p>{BODY}</p></article><p>{BODY} {BODY}</p><p>All rights reserved</p>", f"{BODY}\n{BODY} {BODY}"),
    ],
)
def test_articles_are_a_prior(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article class="post section-social"><p data-id="search">' + BODY + "</p></article>", BODY),
        (f"<div class=ad>Buy<p>{BODY}</p><p>{BODY}</p>", f"{BODY}\n{BODY}"),
        (f"<article><p>{BODY}</p><p>See <a href=x>the long list of all the other things that they had</a> for more of what was in it.</p><p>{BODY}</p></article>", f"{BODY}\nSee the long list of all the other things that they had for more of what was in it.\n{BODY}"),
        (f"<article><p>{BODY}</p></article><article class='comment-body'><p>{BODY}</p></article>", BODY),
        (f"<p>{BODY}</p><!-- never closed <p>x</p>", BODY),
        (f"<p>{BODY}</p><a href='x", BODY),
        ("<p>Hello</p>", "Hello"),
    ],
)
def test_attributes_and_open_elements(page, text):
    assert html_text.main_text(page) == text


def test_rules_decide_without_article_elements(spark):
    """Block rules alone give what they give beside article and main elements, and both passes decide blocks."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub(r"</?(?:article|main)\b[^>]*>", "", h) for h in pages]
    assert [html_text.main_text(h) for h in pages] == [html_text.main_text(h) for h in bare]
    total = Counter()
    for h in bare:
        total.update(html_text.decided(h))
    assert total["first_good"] > 500 and total["second_good"] > 500


def test_planted_texts():
    """Pages of plain divs: text between lists of links, teasers and short lines; most of its characters come out, and little else."""
    rng = np.random.default_rng(11)
    stops, plain = "the of and to in that it was for on with as his they at be this from".split(), [f"w{chr(97 + i)}{chr(97 + j)}rd" for i in range(20) for j in range(5)]
    prose = lambda n: " ".join(rng.choice(stops) if rng.random() < 0.4 else rng.choice(plain) for _ in range(n))
    links = lambda n: "".join(f"<div><a href=x>{' '.join(rng.choice(plain, 3))}</a></div>" for _ in range(n))
    hit = total = extra = 0
    for _ in range(200):
        body = [("h2" if rng.random() < 0.15 else "p", prose(int(rng.integers(4, 9)) if rng.random() < 0.2 else int(rng.integers(15, 80)))) for _ in range(int(rng.integers(3, 12)))]
        body[-1] = ("p", prose(40))
        around = f"<div>{' '.join(rng.choice(plain, 3))}</div>"
        page = f"<body>{links(6)}{around}{links(3)}" + "".join(f"<{t}>{x}</{t}>" for t, x in body) + f"{links(4)}{around}{links(4)}</body>"
        got, want = set(html_text.main_text(page).split("\n")), {x for _, x in body}
        hit, total, extra = hit + sum(map(len, got & want)), total + sum(map(len, want)), extra + sum(map(len, got - want))
    assert hit >= 0.97 * total and extra <= 0.02 * total


@pytest.mark.parametrize("page", ["<a " * 10**5, "<!" * 10**5, "<a '" * 10**5 + ">", "<script>" * 10**5, "<!--" * 10**5, "<div class=ad>" * 10**5, "<p>x" * 10**5, "<div>" * 10**5 + "</div>" * 10**5, "<a \">" * 10**5, "&amp" * 10**5, "<p " + "class " * 10**5 + ">"], ids=lambda t: t[:8])
def test_long_pages_take_linear_time(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 10


def test_html_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = spark.createDataFrame([(None, None, None), (7, "u", "")], "page_id long, url string, html string")
    out = html_text.extract(pages.unionByName(extra), spark).collect()
    assert len(out) == pages.count() + 2 and all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(extra.limit(0), spark).count() == 0


# Quality


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, spark)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([g.predicted == q for g, q in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted} and kept.columns == docs.columns


def test_quality_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(odd, none, spark)
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5}
    some = quality.train(odd, spark.createDataFrame([(3, 1), (3, 1), (5, 0), (None, 1), (8, None), (9, 7)], "doc_id long, quality int"), spark)
    assert quality.score(odd, some).count() == odd.count() and quality.score(empty, some).count() == 0
    assert quality.keep_good(odd, some).columns == odd.columns


def test_model_learns_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.9 and (model.pairs[0][:2]) == (0, 1)


# Archives


def test_archives(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(None, "u\nv", "x"), (901, None, "x"), (900, "é", "x"), (902, "n", None), (903, "n", ""), (904, "n", "a\r\n\r\nWARC/1.1\r\n" * 3), (904, "n", "a\r\n\r\nWARC/1.1\r\n" * 3), (905, "l", "é" * 300_000)], "page_id long, url string, html string")
    both = pages.unionByName(odd)
    got = warc.round_trip(both, spark).collect()
    html = [(r.page_id, (r.html or "").encode()) for r in both.collect()]
    top = defaultdict(list)
    for i, h in html:
        top[h].append(-1 if i is None else i)
    for r in got:
        assert r.payload_bytes in {len(h) for i, h in html if i == r.page_id}
    by = Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in got)
    want = Counter()
    for h, ids in top.items():
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        for n, i in enumerate(sorted(ids, reverse=True)):
            want[(None if i < 0 else i, "revisit" if n else "response", max(ids) if n else None, digest, len(h))] += 1
    assert by == want
    names = {r.record_id: r for r in got}
    assert len(names) == len(got) and all(names[r.refers_to_record].record_type == "response" for r in got if r.record_type == "revisit")
    assert warc.round_trip(odd.limit(0), spark).count() == 0


# Mixing


def brute_targets(sizes):
    total, weights = 1.5 * sum(sizes.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped: set = set()
    while True:
        rest = [s for s in sizes if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / max(1, sum(weights[s] for s in rest))
        over = {s for s in rest if weights[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else weights[s] * level for s in sizes}
        capped |= over


@pytest.mark.parametrize("table", ["odd", "docs", "tiny", "one"])
def test_mix(spark, request, table):
    if table == "tiny":
        df = spark.createDataFrame([(1, "a b c d e", "s")], "doc_id long, text string, source string")
    elif table == "one":  # a small source beside a large one, many null ids and repeated rows
        rows = [(None, f"w{i} x y", "big") for i in range(3000)] + [(7, "r s t", "big")] * 500 + [(i, "k l", "small") for i in range(5)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    else:
        df = request.getfixturevalue(table)
    rows = df.collect()
    sizes = defaultdict(int)
    by_id = defaultdict(set)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
        by_id[r.doc_id].add(r.source)
    want = brute_targets(sizes)
    got = mixing.mix(df, shard_rows=1000).collect()
    assert sorted(repr((r.doc_id, len(WORD.findall(r.text or "")), sizes[r.source], round(float(want[r.source]), 6))) for r in rows) == sorted(repr((r.doc_id, r.size, r.source_size, round(r.target, 6))) for r in got)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    expected = defaultdict(float)
    for s, t in want.items():
        expected[sizes[s], round(float(t), 6)] += t
    assert all(abs(taken[s] - expected[s]) <= max(1, 0.01 * expected[s]) for s in expected)
    again = sorted(repr((r.doc_id, r.size, r.taken)) for r in mixing.mix(df.repartition(3), shard_rows=1000).collect())
    assert again == sorted(repr((r.doc_id, r.size, r.taken)) for r in got)
    texts = mixing.mixed_documents(df, shard_rows=1000)
    assert texts.columns == df.columns
    words = Counter()
    whole = defaultdict(set)
    for r in rows:
        whole[r.doc_id].add(" ".join(WORD.findall(r.text or "")))
    for r in texts.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.doc_id is None or any(not Counter(WORD.findall(r.text)) - Counter(WORD.findall(w)) for w in whole[r.doc_id])
    counted = Counter()
    for r in got:
        counted[r.doc_id] += r.taken
    assert words == +counted


def test_seats_by_highest_quotients(spark):
    rng = np.random.default_rng(5)
    share = [float(x) for x in rng.integers(0, 1000, 9)] + [0.0]
    claims = spark.createDataFrame([(i, s, 137) for i, s in enumerate(share)], "k int, share double, total long")
    got = {r.k: r.seats for r in mixing._seats(claims, [], "total", "share", ["k"], "seats").collect()}
    won = Counter()
    for _ in range(137):
        won[max(range(10), key=lambda i: (share[i] / (2 * won[i] + 1), -i))] += 1
    assert got == {i: won[i] for i in range(10)}


# Packing


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_packing(spark, request, table):
    df = request.getfixturevalue(table)
    tokenizer = packing.Encoder(TOKENIZER).tokenizer
    want = Counter()
    for d, t in rows_of(df):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for i in range(0, len(ids), 2048):
            want[(d, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes()))] += 1
    got = packing.pack_documents(df, spark, TOKENIZER).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 2048 + 2


def test_encoder_matches_tokenizer():
    e = packing.Encoder(TOKENIZER, most=5)  # forgets often
    texts = ["", " ", "Don't I'LL", "x\x07y z", "<|endoftext|> hi", "ΣΑΣ ΟΔΟΣ", "tab\tb c d \x1cf", "́start", "日本語 12３", "\U0001f600\U0001f600 é", "İstanbul", "ﬁ ﬂ ẛ̣", "a\ńb", "Word, word. WORD.. word", "× ÷ ß ÿ Ÿ"]
    for part in (texts, texts[::-1], texts):
        data, offsets = kernel.string_buffers(packing.pa.array(part))
        ids, cuts = e.encode(data, offsets, 0)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in part]


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_patterned_words_differ(spark, n):
    """Words of one length that a polynomial modulo a power of two cannot tell apart."""
    a, b = thue_morse(n)
    data, offsets = kernel.string_buffers(packing.pa.array([a, b, " ".join(a), " ".join(b)]))
    h, _, _, first = kernel.words(data, offsets)
    assert h[0] != h[1] and kernel.grams(h[2 : n + 2], n)[0] != kernel.grams(h[n + 2 :], n)[0]
    e = packing.Encoder(TOKENIZER)
    ids, cuts = e.encode(data, offsets)
    assert [ids[x:y].tolist() for x, y in zip(cuts, cuts[1:], strict=False)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b, " ".join(a), " ".join(b))]
    if n == 1024:
        rows = [(1, a), (2, b), (3, f"{a} {passage(50, 3)}"), (4, f"{b} {passage(50, 3)}"), (5, passage(10, 3) + f" {a} " + passage(40, 7)), (6, passage(10, 3) + f" {b} " + passage(40, 7))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in minhash_dedup.near_duplicates(df, spark, 1).collect()) == sorted(brute_components(rows, 1))
        assert sorted(tuple(r) for r in substring_dedup.remove_repeats(df, spark).collect()) == sorted(brute_removal(rows, 35))


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    own = kernel.hashes
    monkeypatch.setattr(kernel, "hashes", lambda raw, starts, lens: np.where(lens > 8, np.uint64(7), own(raw, starts, lens)))
    e = packing.Encoder(TOKENIZER)
    texts = ["international intercontinental", "transformation internationale x", "international y"]
    for part in (texts, texts[::-1]):
        data, offsets = kernel.string_buffers(packing.pa.array(part))
        ids, cuts = e.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in part]


SIZES = [(300, 700, 3000), (400, 900, 2000), (500, 1000, 1000), (600, 1500, 501), (1, 2048, 800)]


@pytest.mark.parametrize(("low", "high", "n"), SIZES)
def test_genetic_packing(low, high, n):
    """Never more bins than best-fit decreasing; fewer where that is not optimal, and fewer than the best parent had."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(low, high, n)
    pool = packing.parents(sizes, 2048, rng, 4)
    plain, first = packing.fitness(pool[0], sizes, 2048), max(packing.fitness(x, sizes, 2048) for x in pool)
    best = packing.evolve(pool, sizes, 2048, rng, 40)[0]
    fill = np.bincount(best, sizes)
    assert fill.sum() == sizes.sum() and (fill <= 2048).all() and (fill > 0).all()
    assert packing.fitness(best, sizes, 2048) >= first
    if (low, high) in ((300, 700), (400, 900), (500, 1000)):
        assert len(fill) <= -plain[0] - 0.03 * n / 4 and len(fill) < -first[0]
    assert len(packing.decreasing(np.zeros(0, np.int64), 2048)) == 0 and len(packing.filled(np.zeros(0, np.int64), 2048, rng)) == 0


def test_islands(spark):
    """Packed over islands and shards: every piece once, gapless, and fewer sequences than best-fit decreasing has."""
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(400, 900, 3000)] + [2048] * 20
    df = spark.createDataFrame([(i % 50, 0, 0, x, 9) for i, x in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    bins = defaultdict(list)
    rows = packing.pack(df, spark, shard_pieces=1000).collect()
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.length for r in rows) == Counter(sizes)
    for b in bins.values():
        assert [x for x, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    short = np.array(sizes[:3000])
    assert len(bins) - 20 < 0.96 * (packing.decreasing(short, 2048).max() + 1)
    got = packing.gains(df, spark, shard_pieces=1000).collect()
    assert sum(r.pieces for r in got) == 3000 and all(r.least <= r.bins < r.first for r in got)


# Other columns

CLASHES = ["key", "key_", "found", "gone_", "row", "a.b", "Text", "DOC_ID", "c0_", "c1_", "n", "text_", "id", "copies", "k", "size"]


@pytest.fixture(scope="module")
def clashing(spark):
    """The odd table with columns named as operators name theirs, one with a dot, and two that differ from others in case only."""
    rows = [(*r[:5], *(f"x{i}" for i in range(len(CLASHES)))) for r in odd_documents()[:24]]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    return spark.createDataFrame([(*r[:5], *r[5:]) for r in rows], "a0 long, a1 string, a2 string, a3 string, a4 long, " + ", ".join(f"a{i + 5} string" for i in range(len(CLASHES)))).toDF(*names)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_names(spark, clashing, stage):
    plain = clashing.toDF(*(f"c{i}" for i in range(len(clashing.columns)))).selectExpr("c0 doc_id", "c1 text", "c2 lang", "c3 source", "c4 n_chars")
    f = dict(corpus_pipeline.STAGES)[stage]
    got, want = f(spark, clashing, SF), f(spark, plain, SF)
    if got.columns != want.columns:
        assert got.columns == clashing.columns
        assert all(tuple(r)[5:] == tuple(f"x{i}" for i in range(len(CLASHES))) for r in got.collect())
        got = got.toDF(*(f"c{i}" for i in range(len(got.columns)))).selectExpr("c0 doc_id", "c1 text", "c2 lang", "c3 source", "c4 n_chars")
    else:
        got, want = got.drop("sequence_id", "offset"), want.drop("sequence_id", "offset")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_operators_with_clashing_names(spark, clashing):
    plain = clashing.toDF(*(f"c{i}" for i in range(len(clashing.columns)))).selectExpr("c0 doc_id", "c1 text", "c3 source")
    model = quality.Model()
    for f in (lambda d: pii.digest(d, spark), lambda d: minhash_dedup.near_duplicates(d, spark), mixing.mix, lambda d: substring_dedup.remove_repeats(d, spark), lambda d: quality.score(d, model)):
        assert sorted(map(repr, f(clashing).collect())) == sorted(map(repr, f(plain).collect()))
    pages = spark.createDataFrame([(1, "u", "<p>Hello</p>", "x", "y", "z"), (2, "u", "<p>Hello</p>", "x", "y", "z")], "page_id long, url string, html string, a string, key string, digest string").withColumnRenamed("a", "HTML")
    assert [r.text for r in html_text.extract(pages, spark).collect()] == ["Hello", "Hello"]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages, spark).collect()) == [(1, "revisit", 2), (2, "response", None)]


# Empty tables


def test_empty_tables(spark, empty):
    assert substring_dedup.remove_repeats(empty, spark).count() == 0
    assert minhash_dedup.near_duplicates(empty, spark).count() == 0
    assert pii.digest(empty, spark).count() == 0 and pii.redact(empty, spark).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert packing.pack_documents(empty, spark, TOKENIZER).count() == 0
