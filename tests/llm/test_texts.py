"""Toxicity, main text, lines, byte strings and near copies on small tables and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoframe.llm.components import star_components
from cytoframe.llm.html_text import main_text, op7_html_extraction
from cytoframe.llm.near_duplicates import keep_one_of_each, near_duplicates, op10_minhash
from cytoframe.llm.suffix_arrays import permuted_prefixes, suffix_array
import cytoframe.llm.suffix_arrays as suffix_arrays
from cytoframe.llm import suffix_dedup
from cytoframe.llm.suffix_dedup import op8_suffix_array, remove_repeats, repeated_windows
from cytoframe.llm.toxicity import marginals, op2_toxicity, score_toxicity, toxicity_model, without_copies
from cytoframe.llm.unit_dedup import OP6_SQL, drop_repeated_units, op6_unit_dedup
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, score double, digest string, spans string, component_id int, kept string"


def frame(spark, rows, schema=DOCS):
    """Rows of an id and a text, with other columns of clashing names."""
    return spark.createDataFrame([(i, t, 1.0, "x", "y", 2, "z") for i, t in rows], schema)


# --- toxicity -------------------------------------------------------------------------------------------


def chain_by_enumeration(scores, start, moves):
    n = len(scores)
    total, one = 0.0, np.zeros(n)
    for code in range(2**n):
        states = [(code >> i) & 1 for i in range(n)]
        weight = start if states[0] else 1.0
        for i, s in enumerate(states):
            weight *= scores[i] if s else 1.0
            if i:
                weight *= moves[states[i - 1]][s]
        total += weight
        one += weight * np.array(states)
    return one / total


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(4)
    lengths = np.array([7, 5, 5, 1, 0])
    scores, moves = draw.gamma(1.0, size=18), draw.gamma(1.0, size=(2, 2))
    got = marginals(scores, lengths, 0.7, moves)
    at = 0
    for n in lengths[:-1]:
        assert np.allclose(got[at : at + n], chain_by_enumeration(scores[at : at + n], 0.7, moves))
        at += n


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(7)
    words = ["".join(draw.choices("abdeilmnorstu", k=draw.randrange(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        text = draw.choices(words, k=draw.randrange(5, 80))
        toxic = i % 5 == 0
        for _ in range(draw.randrange(2, 5) if toxic else 0):
            text[draw.randrange(len(text))] = draw.choice(["Zwok", "grumpf!", "vexq" + draw.choice(words)])
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_rows(spark, folder, labelled):
    docs, labels = labelled
    path = folder(
        documents=frame(spark, docs + [(None, None), (5000, ""), (0, docs[0][1])]),
        labels=spark.createDataFrame(labels + [(None, 1), (7, None), (99999, 1), (8, 5)], "doc_id bigint, toxic int"),
    )
    rows = op2_toxicity(spark, path).collect()
    assert len(rows) == 903
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    texts = dict(docs)
    for r in held:
        for s in r.spans:
            if r.doc_id % 5 == 0 and s.marginal > 0.9:
                assert re.match(r"Zwok|grumpf|vexq", texts[r.doc_id][s.start : s.end])
    lowest = min(r.score for r in rows)
    assert [r.score for r in rows if r.doc_id == 5000] == [lowest] == [r.score for r in rows if r.doc_id is None]


def plainly_without_copies(docs, toxic):
    def triples(words):
        return {tuple(w.lower() for w in words[i : i + 3]) for i in range(max(1, len(words) - 2))}

    kept = []
    for i, words in enumerate(docs):
        own = triples(words)
        earlier = [triples(docs[j]) for j in kept if toxic[j] == toxic[i]]
        if not any(len(own & e) >= 0.8 * len(own | e) for e in earlier):
            kept.append(i)
    return kept


def test_sample_loses_near_copies_of_a_class_only():
    draw = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    docs, toxic = [], []
    for i in range(60):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([1, 2, 30, 200]))]
        changed = list(base)
        changed[draw.randrange(len(base))] = "other"
        shares = passage + [f"w{draw.randrange(5000)}" for _ in range(60)]
        for words, y in ((base, i % 2), (base, i % 2), (base, 1 - i % 2), (changed, i % 2), (shares, i % 2)):
            docs.append(words)
            toxic.append(bool(y))
    docs += [[], []]
    toxic += [False, False]
    kept = without_copies(docs, np.array(toxic))
    assert kept == plainly_without_copies(docs, toxic)
    assert {i for i in range(4, 300, 5)} <= set(kept)  # a shared passage is no copy
    assert {i for i in range(0, 300, 5)} | {300} <= set(kept) and 301 not in kept


def test_toxicity_without_labels(spark, folder, labelled):
    docs = frame(spark, labelled[0][:20])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    one_class = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, toxic int")
    assert {r.score for r in score_toxicity(docs, toxicity_model(docs, none)).collect()} == {0.0}
    assert {r.score for r in score_toxicity(docs, toxicity_model(docs, one_class)).collect()} == {1.0}
    path = folder(documents=frame(spark, []), labels=one_class)
    assert op2_toxicity(spark, path).collect() == []


# --- main text ------------------------------------------------------------------------------------------


def test_supplied_pages(spark):
    """The supplied pages hold their text in one article element."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in op7_html_extraction(spark, SF).collect()}
    for p in pages:
        inside = p.html.split("<article>")[1].split("</article>")[0]
        blocks = [html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h\d|br|div|ul|li)\b[^>]*>", inside)]
        want = "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_supplied_pages_without_article(spark):
    """Surge and dive alone find the same text."""
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        bare = p.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert bare != p.html and "<main" not in bare and main_text(bare) == main_text(p.html)


PAGES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<nav><a href=/>Home</a></nav><footer>end</footer>", ""),
    ("<p>a  b\n c&nbsp;d</p><script>var x='</p>';</script><p>2 &lt; 3", "a b c d\n2 < 3"),
    ('<body><header><h1>Site</h1></header><div class="side sidebar"><p>links<div>x</div></div>'
     "<div id=content><h1>Title</h1><p>Some long paragraph with a good many words in it.</p><p>Short.</p></div>"
     '<div id="comments"><p>First!</p></div><form><p>Mail</p></form></body>',
     "Title\nSome long paragraph with a good many words in it.\nShort."),
    ("<main><article><header><h2>Head</h2></header><p>One.<aside>no</aside><p>Two.<div class=advert>buy</div><p>Three."
     "<section class='cookie-notice'>ok?</section></article></main><footer>f</footer>", "Head\nOne.\nTwo.\nThree."),
    ("<article><p>open <b>bold <i>it</i><ul><li>x<li>y</ul><!-- gone <p>no</p> -->tail", "open bold it\nx\ny\ntail"),
    ("<div class=nav>menu<article><p>text inside</p></article>", "text inside"),
    ("<p title=\"a > b\">quoted</p><p title=\"never closed>lost?</p>", None),
]


LONG = "A reader has a great deal to say about it, " * 9


def test_articles_in_comments_and_side_by_side():
    comment = f"<article class='comment'><p>{LONG}</p></article>"
    inside = f"<section class='comments'>{comment}{comment}</section>"
    for page, want in (
        (f"<main><p>The text.</p>{inside}<p>More of it.</p></main>", "The text.\nMore of it."),
        (f"<article><p>The text.</p></article>{inside}", "The text."),
        (f"<article><p>The text.</p></article>{comment}<footer>f</footer>", "The text."),
        ("<h1>Blog</h1><article><h2><a href=x>One</a></h2><p>First text.</p></article><p>between</p>"
         "<article><h2><a href=y>Two</a></h2><div><a>by</a></div><div><a>on</a></div><p>Second and longer text.</p></article>",
         "One\nFirst text.\nTwo\nby\non\nSecond and longer text."),
        ("<article><p>The text.</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>And its end.</p></article>"
         + "".join(f"<article><a href=z>teaser {i}</a></article>" for i in range(4)), "The text.\na\nb\nc\nAnd its end."),
        ("<div id=page><div class=nav>menu<div>x</div><article><p>text inside</p></article></div>", "text inside"),
        ("<ul><li class=ad>buy</ul><p>A page without an article.</p>", "A page without an article."),
    ):
        assert main_text(page) == want, page


def test_class_names_count_as_a_whole():
    body = "<p>" + "The article says something in so many words. " * 4 + "</p>"
    said = ("The article says something in so many words. " * 4).strip()
    for name, extra, kept in (
        ("p", "class='share price'", True), ("div", "class=ad-vantages", True), ("div", "class='share-price'", True),
        ("p", "class=notice", True), ("div", "class=commentary", True), ("div", "id=research", True),
        ("div", "class=ad-slot", False), ("div", "class='share buttons'", False), ("p", "class=advert", False),
        ("div", "class='cookie-banner top'", False), ("section", "class=related-posts", False), ("div", "class=ad_300", False),
    ):
        page = f"<article>{body}<{name} {extra}>What stands here.</{name}>{body}</article>"
        want = f"{said}\nWhat stands here.\n{said}" if kept else f"{said}\n{said}"
        assert main_text(page) == want, extra


def test_lists_of_links_inside_a_text_stay():
    text = "A paragraph of the page that is long enough to weigh something in every count of characters there may be. " * 2
    links = "".join(f"<li><a href=/{i}>a link to page {i}</a></li>" for i in range(6))
    listed = "\n".join(f"a link to page {i}" for i in range(6))
    first, second = text.strip(), (text * 2).strip()
    page = f"<body><div><p>{first}</p><ul>{links}</ul><p>{second}</p></div></body>"
    assert main_text(page) == f"{first}\n{listed}\n{second}"
    page = f"<body><div><h1>Headline</h1><ul>{links}</ul><p>{second}</p></div></body>"
    assert main_text(page) == f"Headline\n{listed}\n{second}"
    # a menu before the text, in a block of its own or beside it, is none of it
    for menu in (f"<div><p>Site</p><ul>{links}</ul></div>", f"<ul>{links}</ul>"):
        assert main_text(f"<body>{menu}<div><p>{first}</p><p>{second}</p></div></body>") == f"{first}\n{second}"


def test_pages_by_hand(spark, folder):
    for page, want in PAGES:
        if want is not None:
            assert main_text(page or "") == want, page
        else:
            main_text(page)
    rows = [(i, None if i == 2 else "u", h, "t", 3) for i, (h, _) in enumerate(PAGES)] + [(0, "u", None, "t", 3)]
    path = folder(pages=spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int"))
    got = op7_html_extraction(spark, path).collect()
    assert len(got) == len(rows) and sum(r.page_id == 0 for r in got) == 2
    long = "<article>" + "<p>word</p>" * 50_000
    assert main_text(long) == "\n".join(["word"] * 50_000)
    none = folder(pages=spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert op7_html_extraction(spark, none).collect() == []


# --- lines ----------------------------------------------------------------------------------------------


def test_lines_equal_sql(spark):
    assert compare(op6_unit_dedup(spark, SF), connect(SF), OP6_SQL) is None


def test_lines_by_hand(spark, folder):
    line = "this line has six words here"
    rows = [
        (2, f"{line}\nown text\n{line.upper()}  "),
        (1, f"first\n  This LINE has\tsix words here\nlast"),
        (3, line),
        (3, line),
        (None, f"{line}\nshort\nshort"),
        (4, None),
        (5, ""),
        (6, "\n\n" + line),
    ]
    result = drop_repeated_units(frame(spark, rows)).collect()
    got = Counter((r.row.doc_id, r.kept_text, len(r.removed)) for r in result)
    assert got == Counter(
        {(2, "own text", 2): 1, (1, rows[1][1], 0): 1, (3, "", 1): 2, (None, "short\nshort", 1): 1, (4, "", 0): 1,
         (5, "", 0): 1, (6, "\n", 1): 1}
    )
    for r in result:
        for s in r.removed:
            assert " ".join(r.row.text[s.start : s.end].lower().split()) == line
    again = drop_repeated_units(frame(spark, rows), broadcast_rows=0).collect()
    assert Counter((r.row.doc_id, r.kept_text, len(r.removed)) for r in again) == got
    by_rank = drop_repeated_units(frame(spark, [(1, line), (2, line)]).withColumn("rank", -F.col("doc_id")), rank=("rank",))
    assert sorted((r.row.doc_id, r.kept_text) for r in by_rank.collect()) == [(1, ""), (2, line)]
    paragraphs = drop_repeated_units(frame(spark, [(1, f"{line}\nb\n\n{line}"), (2, f"x\n\n{line}\nb")]), unit="paragraph")
    assert sorted((r.row.doc_id, r.kept_text) for r in paragraphs.collect()) == [(1, f"{line}\nb\n\n{line}"), (2, "x")]
    path = folder(documents=frame(spark, []))
    assert op6_unit_dedup(spark, path).collect() == []


def test_passages_inside_lines(spark):
    """Sentences count too: a passage in the middle of other lines goes, what stands around it stays."""
    passage = "One sentence of the passage here. And another one that follows it!"
    rows = [
        (1, f"Some words before it. {passage} Short end."),
        (2, f"Other start of the line. {passage}\nnext line"),
        (3, passage),
        (4, f"{passage} {passage}"),
        (5, "One. Two. Three."),
        (6, "One. Two. Three."),
    ]
    got = {r.row.doc_id: (r.kept_text, r.n_units, [(s.start, s.end) for s in r.removed])
           for r in drop_repeated_units(frame(spark, rows), unit="sentence").collect()}
    assert got[1] == (rows[0][1], 4, [])
    assert got[2] == ("Other start of the line.\nnext line", 4, [(25, 58), (59, 91)])
    assert got[3][0] == "" and got[3][2] == [(0, 33), (34, 66)]
    assert got[4][0] == "" and len(got[4][2]) == 4
    assert got[5] == got[6] == ("One. Two. Three.", 3, [])


def test_short_lines_and_glued_passages(spark):
    """Whole lines count at any length; a removed sentence takes along what its earliest one has beside it."""
    first, second, third = "The first sentence opens the planted passage.", "A second one of it follows here.", "The third sentence closes it at last."
    passage = f"{first} Yes. {second} So be it. {third} The end."
    rows = [
        (1, f"Host words {passage} Own words of the first host."),
        (2, f"Quite another start {passage} Something else."),
        (3, "all rights reserved.\nown"),
        (4, "All  rights reserved.\nown\nOne. Two."),
        (5, f"One. Two.\nNo. {second} Never. {third} Not so."),
        (6, "q e. one two three four e. one two three four e."),
    ]
    docs = frame(spark, rows)
    result = drop_repeated_units(docs, unit="passage").collect()
    got = {r.row.doc_id: r.kept_text for r in result}
    assert got == {
        1: rows[0][1], 2: "Quite another start Something else.", 3: rows[2][1], 4: "One. Two.", 5: "No. Never. Not so.",
        6: "q e. one two three four e.",
    }
    for r in result:
        cut = [r.row.text[s.start : s.end] for s in r.removed]
        assert all(cut) and len("".join(cut).split()) <= len(r.row.text.split())
        if r.row.doc_id == 2:
            assert cut == [first, "Yes.", second, "So be it.", third, "The end."]


# --- byte strings ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("wide", [0, 10**9])
def test_suffix_arrays(monkeypatch, wide):
    monkeypatch.setattr(suffix_arrays, "WIDE", wide)
    draw = random.Random(2)
    for _ in range(200):
        n, symbols = draw.randrange(1, 60), draw.choice([1, 2, 3, 20])
        text = [draw.randrange(1, symbols + 1) for _ in range(n)] + [0]
        order = suffix_array(np.array(text), symbols + 1)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:])
        prefix = permuted_prefixes(np.array(text), order, 1000, np.array([0]))
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            m = 0
            while max(a, b) + m <= n and text[a + m] == text[b + m]:
                m += 1
            assert prefix[b] == m


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), dtype=bool)
        for p in range(len(d) - length + 1):
            if starts[d[p : p + length]] > 1:
                covered[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        out.append((bytes(b for b, c in zip(d, covered) if not c), list(zip(edges[::2].tolist(), edges[1::2].tolist()))))
    return out


def test_pieces_with_separators_inside():
    pieces = [b"abcabcabc", b"xabcaby", b"\0\0abc\0", b"\0\0abc\0", b"zz"]
    found = repeated_windows(pieces, 4)
    starts = Counter(p[i : i + 4] for p in pieces for i in range(len(p) - 3))
    for p, ranges in zip(pieces, found):
        assert {i for a, b in ranges for i in range(a, b)} == {i for i in range(len(p) - 3) if starts[p[i : i + 4]] > 1}


@pytest.mark.parametrize("hot", [10**6, 0])
def test_removal_equals_brute_force(spark, hot):
    draw = random.Random(hot)
    blocks = ["".join(draw.choices("abcé\0 ", k=draw.randrange(5, 60))) for _ in range(12)]
    texts = ["".join(draw.choice(blocks) if draw.random() < 0.7 else draw.choice("xyz") * 9 for _ in range(8)) for _ in range(120)]
    texts += [None, "", "short", "a" * 700, texts[0], texts[0]]
    docs = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    got = remove_repeats(frame(spark, docs), 40, 16, hot).collect()
    want = Counter()
    for (i, t), (kept, spans) in zip(docs, plain_removal(texts, 40)):
        want[(i, (t or "").encode(), kept, tuple(spans))] += 1
    assert Counter((r.doc_id, bytes(r.bytes), bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in got) == want


def test_copies_of_a_text_are_sorted_once(spark, monkeypatch):
    """No shard grows with the copies of a text; what they share with other texts is still found."""
    tables, written = {}, suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    draw = random.Random(8)
    word = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    passage = word(90)
    texts = [word(50) + passage + word(50)] * 40 + [word(50) + passage + word(50) for _ in range(6)] + [word(300)]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in remove_repeats(frame(spark, docs).repartition(4), 40, 16).collect()}
    assert got == dict(enumerate(plain_removal(texts, 40)))
    assert got[0][1] == got[39][1] == [(0, 190)] and got[46][1] == []
    segments = tables["feed"].select("anchor", "digest").collect()
    assert len(segments) == len(set(segments)) > 6
    assert tables["feed"].groupBy("anchor").count().agg(F.max("count")).first()[0] <= 7


@pytest.mark.parametrize("sf, hot", [("sf0.001", 4096), ("sf0.01", 4096), ("sf0.01", 3)])
def test_supplied_byte_strings(spark, folder, sf, hot):
    """Whole tables against all windows; with a small ``hot`` many anchors are counted instead of sorted."""
    path = f"/root/testdata/{sf}/documents.parquet"
    docs = spark.read.parquet(path).select("doc_id", "text").collect()
    if hot == suffix_dedup.HOT:
        got = {r.doc_id: r for r in op8_suffix_array(spark, f"/root/testdata/{sf}").collect()}
    else:
        made = remove_repeats(spark.read.parquet(path), hot=hot)
        got = {r.doc_id: r for r in made.select(
            "doc_id", F.octet_length("bytes").alias("n_bytes"), (F.octet_length("bytes") - F.octet_length("kept")).alias("n_removed"),
            F.size("spans").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")).collect()}
    assert len(got) == len(docs)
    removed = 0
    for d, (kept, spans) in zip(docs, plain_removal([d.text for d in docs], 400)):
        r = got[d.doc_id]
        size = len(d.text.encode())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, size - len(kept), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
        removed += size > len(kept)
    assert removed > (100 if sf == "sf0.01" else 10)
    assert op8_suffix_array(spark, folder(documents=frame(spark, []))).collect() == []


# --- near copies ----------------------------------------------------------------------------------------


def plain_components(rows, k, percent=80):
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not words:
            return frozenset()
        return frozenset([tuple(words)] if len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_supplied_near_copies(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_components(rows, 2)
    got = op10_minhash(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_of_a_hot_group(spark):
    """A group with chains of edits, in which many pairs are alike and many are not, in blocks."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, text = [], draw.choices(words, k=120)
    for i in range(700):
        edited = list(text)
        for _ in range(draw.randrange(1, 12)):
            edited[draw.randrange(120)] = draw.choice(words)
        rows.append((i * 3, " ".join(edited)))
        if i % 50 == 0:
            text = edited
    rows += [(5000 + i, " ".join(draw.choices(words, k=60))) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), words=2).collect()}
    assert got == plain_components(rows, 2)


def test_near_copies_by_hand(spark, folder):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [
        (9, text), (4, text.upper()), (7, text + " more"), (3, None), (2, ""), (1, " \n\t"), (11, "single"), (12, "Single"),
        (None, text), (20, "a b c"), (21, "a b c"), (30, "x " * 30000),
    ]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), 2).collect())
    assert got == Counter({
        (9, 59, 4, False): 1, (4, 59, 4, True): 1, (7, 60, 4, False): 1, (3, 0, 3, True): 1, (2, 0, 2, True): 1,
        (1, 0, 1, True): 1, (11, 1, 11, True): 1, (12, 1, 11, False): 1, (None, 59, None, True): 1, (20, 1, 20, True): 1,
        (21, 2, 21, True): 1, (30, 1, 30, True): 1,
    })
    kept = keep_one_of_each(frame(spark, rows + [(4, text)]))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 11, 20, 21, 30]
    assert op10_minhash(spark, folder(documents=frame(spark, []))).collect() == []
    with pytest.raises(ValueError):
        near_duplicates(frame(spark, rows), percent=50)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (1, 1)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(pd.DataFrame(links, columns=["u", "v"]))
    got = {r.node: r.component for r in star_components(df).collect()}
    want = {1: 1, 2: 1, 3: 1} | {i: 4 for i in range(4, 10)} | {i: 100 for i in range(100, 141)}
    assert got == want
    assert star_components(df.limit(0)).collect() == []
