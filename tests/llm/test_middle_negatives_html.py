"""Fill-in-the-middle, hard negatives and HTML extraction against brute force, hand cases and odd rows."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import fim, html_text, negatives

TEXTS = [None, "", " \t", "one", " one two\n", "a <P> b", "x y z é 😀 漢字\r\n end ", "w" * 300_000, "many words " * 30_000, *(f"row {i} has some words, and {i % 7} more\n" for i in range(200))]


def plain_fim(key, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = [int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_brute_force_and_goes_back(spark):
    rows = [(i, t, "old", i) for i, t in enumerate(TEXTS)] + [(3, "one", "again", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, `_text` long")
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], TEXTS[r["doc_id"]])
        assert r["back"] == (TEXTS[r["doc_id"]] or "") and r["_text"] == r["doc_id"]


def test_fim_without_rows_or_key(spark):
    none = spark.createDataFrame([], "doc_id long, text string, `a.b` int")
    assert fim.fill_in_middle(none).columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fim.fill_in_middle(none).count() == 0
    row = fim.fill_in_middle(spark.createDataFrame([(None, "a b c", 1)], none.schema)).first()
    assert row["a.b"] == 1 and (row["n"], row["form"], row["output"]) == (plain_fim("", "a b c")[0], *plain_fim("", "a b c")[1::3])


def test_fim_cut_keeps_no_units():
    import tracemalloc

    text = "ab " * 400_000
    tracemalloc.start()
    assert fim.cut(text, 7, 300_001) == (400_001, 7 * 3 - 1, 300_001 * 3 - 1)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def brute_negatives(rows, positives=5, negatives=5):
    whole = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for a, label, v in whole:
        if a % 100 == 0:
            scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, y) for i, y, w in whole if i != a]
            for ps, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
                inside = sorted(x for x in scored if x[2] != label and 80 * -ps <= 100 * -x[0] <= 100 * -ps)
                found += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(inside[:negatives])]
    return sorted(found)


@pytest.mark.parametrize(("chunk", "block", "span"), [(8192, 2048, 1.0), (64, 3, 1.0), (50, 2, 3000.0)])
def test_negatives_equal_brute_force(spark, chunk, block, span):
    rng = random.Random(5)
    centres = [[rng.gauss(0, span) for _ in range(12)] for _ in range(4)]
    vectors = [[x + rng.gauss(0, 0.3 * span) for x in rng.choice(centres)] for _ in range(700)]
    vectors[300:420] = [vectors[100]] * 120  # a common vector: ties by id
    rows = [(i, 1 if i % 3 else rng.randrange(4), v) for i, v in enumerate(vectors)]
    rows += [(1000, None, vectors[0]), (None, 1, vectors[0]), (1100, 1, None), (1200, 1, [None] * 12), (1300, 1, [math.nan] * 12), (1400, 1, [math.inf] * 12), (1500, 1, [0.0] * 12)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, vector array<double>, dim string")
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 100 == 0, chunk=chunk, block=block).collect())
    assert got == brute_negatives(rows) and len(got) > 20


def test_negatives_of_odd_rows(spark):
    kind = "id long, label int, vector array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], kind), F.col("id") % 100 == 0).count() == 0
    rows = [(100, 0, [1.0]), (1, 0, [1.0]), (2, 1, [0.9]), (3, 1, [0.9, 0.1]), (4, 1, [1e9]), (2, 1, [0.9]), (100, 0, [1.0]), (5, 1, [-1.0])]
    got = negatives.hard_negatives(spark.createDataFrame(rows, kind), F.col("id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == [(100, 1, 1, 2, 65536, 58880), (100, 1, 2, 2, 65536, 58880)]
    alone = spark.createDataFrame([(100, 0, [-1.0]), (1, 0, [1.0]), (2, 1, [-1.0])], kind)  # the positive is under zero
    assert negatives.hard_negatives(alone, F.col("id") % 100 == 0).count() == 0


def test_negatives_drop_most_candidates():
    import numpy as np

    rng = np.random.default_rng(1)
    whole = rng.integers(-200, 200, (4000, 32))
    bits, anchor = 9, whole[0].astype(np.float64)
    packed = [b"".join(np.packbits(((row >> j) & 1).astype(np.uint8)).tobytes() for j in range(bits - 1, -1, -1)) for row in whole]
    planes, seen = negatives._planes(packed, 32, bits, np.float64), []

    def drop(low, high):
        exact = whole[: len(low)] @ whole[0] if len(low) == 4000 else None
        assert exact is None or ((low <= exact) & (exact <= high)).all()
        seen.append(len(low))
        return high < negatives._nth_largest(low, 5)

    alive, scores = negatives._refined(planes, [], anchor, np.arange(4000), drop)
    assert (scores == whole[alive] @ whole[0]).all() and set(np.argsort(-(whole @ whole[0]))[:5]) <= set(alive)
    assert seen == sorted(seen, reverse=True) and len(alive) < 20


PAGES = {
    "article": (
        "<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><nav><a href=/>Home</a> <a>News</a></nav><header>Site</header>"
        "<div id='cookieNotice'>We use cookies on this site, please accept them all.</div><article class='post'><header><h1>Head &amp; tail</h1><p>By A.</p></header>"
        "<p>First <b>bold</b>\n  text&nbsp;here<br>next line. <button>Share</button></p><ul><li>one<li>two</ul><aside>Related: a long text that is not content at all.</aside>"
        "<div class=\"ad\">Buy this, it is very good and cheap today.</div><form><label>Mail</label></form><p>Last &lt;p&gt; &#233;&eacute;</p>"
        "<section class='comments'><article><p>A reader's comment that is far longer than all of the article, which is short, and goes on and on.</p></article></section>"
        "</article><aside>Side</aside><footer>&copy; 2020</footer><script>var a='<p>no</p>';</script></body></html>",
        ["Head & tail", "First bold text here next line.", "one", "two", "Last <p> éé"],
    ),
    "no article": (
        "<body><ul class=menu><li>a</ul><div id=top><a>x</a><a>y</a><a>z</a></div><div id=story><h2>Short</h2><p>A long paragraph of a story, with many words in it, more than any other."
        "<p>And a second one, which is as long as the first one is, or so it seems to me.</div><div><a>l1</a> <a>l2</a> <a>l3</a></div><div class='page-footer'>foot</div></body>",
        ["Short", "A long paragraph of a story, with many words in it, more than any other.", "And a second one, which is as long as the first one is, or so it seems to me."],
    ),
    "broken": ("<nav><ul><li><a>Home</a><article><h1>Hi</h1></div></section><p>One <i>two<p>three</article><p>out", ["Hi", "One two", "three"]),
    "table": ("<main><table><tr><td>a<td>b</tr><tr><th>c</th><th>d</th></tr></table><pre>x\n  y</pre><!-- <p>gone</p> --><hr>z</main>", ["a b", "c d", "x y", "z"]),
    "whole form": ("<form action=/><div><article><P>Text IN capitals.</P></article></div></form>", ["Text IN capitals."]),
    "no markup": ("just   words &amp; more", ["just words & more"]),
    "only menus": ("<nav>a</nav><footer>b</footer>", []),
    "unended script": ("<article><p>a b c</p></article><script>var x = '<p>no</p>", ["a b c"]),
    "references": ("<article><p>&#0; &#xD800; &bogus; &#x1F600;</p></article>", ["� � &bogus; 😀"]),
    "blank": (" \n ", []),
    "empty": ("", []),
    "null": (None, []),
}


def test_html_hand_cases(spark):
    pages = spark.createDataFrame([(k, v[0], 1, "x") for k, v in PAGES.items()] * 2, "page_id string, html string, n_chars int, `a.b` string")
    got = html_text.extract(pages).collect()
    assert len(got) == 2 * len(PAGES) and got[0].asDict().keys() == {"page_id", "html", "a.b", "text", "n_chars"}
    for r in got:
        assert r["text"] == "\n\n".join(PAGES[r["page_id"]][1]), r["page_id"]
        assert r["n_chars"] == len(r["text"])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_long_page_in_slices():
    text = [f"Paragraph {i} has a few words &amp; a number." for i in range(20_000)]
    page = f"<nav>menu</nav><article>{''.join(f'<p class=x{i}>{t}</p>' for i, t in enumerate(text))}</article><footer>end</footer>"
    assert html_text.main_text(page) == "\n\n".join(text).replace("&amp;", "&")


def test_html_ratios_are_smoothed_and_clustered():
    flat = html_text.smoothed([5.0] * 9)
    assert all(abs(x - 5.0) < 1e-9 for x in flat)
    peak = html_text.smoothed([0, 0, 0, 0, 1, 0, 0, 0, 0])
    assert peak.index(max(peak)) == 4 and abs(peak[3] / peak[4] - math.exp(-0.5)) < 1e-9
    line = html_text.Line
    lines = [line("m" * 3, 6, (0, 1), False), line("t" * 90, 2, (0, 2), False), line("h" * 9, 2, (0, 2), False), line("t" * 80, 2, (0, 2, 3), False), line("f" * 4, 5, (0, 4), False)]
    assert html_text.region(lines, set()) == 2 and html_text.region(lines, {4}) == 2 and html_text.region([], set()) is None
