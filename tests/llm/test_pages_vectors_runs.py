"""HTML extraction, whitening and periodic runs against plain versions, with nulls, empty and long inputs, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import periodic_runs as R, site_style as S
from corpusloom.llm.whitening import whiten

SF = "/root/testdata/sf0.001"


def plain_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    runs = sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.fixture(scope="module")
def repeated_texts():
    rng, out = random.Random(3), [None, "", " \n ", "a", "a a a a a a", "é" * 9, "x " * 20_000, " ".join(str(i) for i in range(5000))]
    for _ in range(400):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 3, 9]))]
        parts = [[rng.choice(words) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 2, 4, 5, 9]) for _ in range(rng.randint(0, 6))]
        out.append(rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p))
    return out


def test_periodic_runs(spark, repeated_texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(repeated_texts)]
    rows += [rows[9], (None, rows[12][1], None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start string").repartition(3)
    got = [tuple(r) for r in R.periodic_runs(df).collect()]
    want = [plain_runs(r[0], r[1]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 300
    assert R.periodic_runs(df.limit(0)).count() == 0


def test_nearest_smaller():
    rng = np.random.default_rng(0)
    for _ in range(50):
        v = np.append(-1, rng.integers(0, 6, rng.integers(1, 70)))
        at = np.arange(1, len(v))
        assert R.previous_smaller(v, at).tolist() == [max(k for k in range(j) if v[k] < v[j]) for j in at]
        assert R._next_smaller(v, at).tolist() == [next((k for k in range(j + 1, len(v)) if v[k] < v[j]), len(v)) for j in at]


def test_runs_of_a_million_words():
    import pyarrow as pa

    from corpusloom.llm.words import SPACED, chunks

    text = "one two three " * 330_000 + "end " + " ".join(map(str, range(400_000)))
    rows = [r for c in chunks(pa.array([text]), SPACED, cut=False) for r in R._chunk_rows([1], c).to_pylist()]
    assert [(r["n_words"], r["n_runs"], r["start"], r["length"], r["period"]) for r in rows] == [(1_390_001, 1, 0, 990_000, 3)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, component string")


def by_component(rows, k):
    return {r["component"]: r["whitened"] for r in rows if r["vec_id"] == k}


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 20)) * np.linspace(0.2, 3, 20) + 5
    base[:, 3] = base[:, 4]  # one dimension less
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(base)] + [(0, base[0].tolist(), 2, None), (None, base[1].tolist(), None, None)]
    rows += [(900, base[2].tolist(), 0, "")] * 40 + [(901, None, 0, ""), (902, [None, *base[0][1:].tolist()], 0, ""), (903, [float("nan"), *base[0][1:].tolist()], 0, ""), (904, [float("-inf"), *base[0][1:].tolist()], 0, "")]
    out = whiten(vectors(spark, rows).repartition(5)).collect()
    fine = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    assert len(out) == 16 * len(fine)
    x = np.floor(64 * np.array([r[1] for r in fine])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, totals = len(fit), fit.sum(axis=0)
    centred = (n * fit - totals) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    want = ((n * x - totals) / n) @ axes[:, :16] / np.sqrt(e[:16])
    ids = [r[0] for r in fine]
    got = np.array([[by_component(out, k)[c] for c in range(1, 17)] for k in ids])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-9
    assert {r["n"] for r in out} == {n} and max(r["identity_error"] for r in out) < 1e-10
    assert {(r["component"], round(r["explained"], 12)) for r in out} == {(c + 1, round(e[c] / e.sum(), 12)) for c in range(16)}
    deviation = dict(zip(ids, ((n * x - totals) ** 2).sum(axis=1).tolist()))
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in out)


def test_whitening_of_few_and_equal_rows(spark):
    cross = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, -1.0, 0.0]]  # two equal deviations, one of none
    out = whiten(vectors(spark, [(i, v, 0, "") for i, v in enumerate(cross)])).collect()
    w = np.array([[by_component(out, k)[c] for c in (1, 2)] for k in range(4)])
    assert len(out) == 8 and np.allclose(w.T @ w / 4, np.eye(2)) and {round(r["explained"], 9) for r in out} == {0.5}
    for rows in ([], [(1, [1.0, 2.0], 0, "")] * 3, [(1, [], 0, "")], [(1, None, 0, "")]):
        assert whiten(vectors(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        whiten(vectors(spark, [(1, [1.0], 0, ""), (2, [1.0, 2.0], 0, "")]))


def page_text(spark, pages, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars string")
    return sorted(((r["page_id"], r["text"], r["n_chars"]) for r in S.main_text(df, **options).collect()), key=repr)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div>a<b>b</b>c<p>x<p>y<ul><li>1<li>2</ul></div>z", "abc x y 1 2 z"), ("<p it's>q</p>", "q"), ('<span class="ad">no <span>x</span> y</span>yes', "yes"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<nav><div>m</nav>text", "text"),
        ("a &lt;p&gt; b&#160;&nbsp; c&copy; &#x41;", "a <p> b c© A"), ("<script>var t='</p>'</script>x<!-- y --><style>p{}</style>", "x"), ("x<script>y</script", "x"), ('end <a href="x', "end"), ("1 < 2 <3", "1 < 2 <3"),
        ("<article><header><h1>T</h1></header>b<footer>f</footer></article><header>h</header>", "T b"), ('<main><div id="commentList">c</div><div class="article-ad post">k</div><p>t</main><aside>s</aside>', "k t"), ('<form>f<p>g</form><div role="navigation">n</div>m', "m"),
        ("<p><b>open.<br><p>next <i>and</i> last", "open. next and last"), ("a <!-- b", "a"), ("", ""), ("<div></div>", ""), ("x\ty\n z", "x y z"),
    ],
)
def test_main_text_of_one_page(html, text):
    root = S.parse(html)
    assert S.text_of(root, S.judged_nodes(root, "h"), {}) == text


def test_site_style_tree(spark):
    """Unmarked templates: what every page of a host repeats goes, what differs stays; other hosts, small hosts and marked articles are left alone."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    page = lambda i, top="Home News", main="div": f"<html><body><div class='top'><div>{top}</div><div>About us</div></div><{main}><h1>Title {i}</h1>" + "".join(f"<p>{words(i * 10 + k, 5)}</p>" for k in range(3)) + f"</{main}><div class='low'>All of ours</div></body></html>"
    text = lambda i: " ".join([f"Title {i}", *[words(i * 10 + k, 5) for k in range(3)]])
    pages = [(i, f"https://User@Site.example:80/p{i}", page(i), "c", "c") for i in range(8)]
    want = [(i, text(i)) for i in range(8)]
    pages += [(20 + i, f"http://small.example/{i}", page(i), None, None) for i in range(3)]  # too few pages to tell
    want += [(20 + i, f"Home News About us {text(i)} All of ours") for i in range(3)]
    pages += [(30 + i, "http://copies.example/", page(1), None, None) for i in range(9)]  # one page many times is one page
    want += [(30 + i, f"Home News About us {text(1)} All of ours") for i in range(9)]
    pages += [(40 + i, f"http://articles.example/{i}", f"<div>Menu</div><article><p>The same</p></article><p>{i}</p>", None, None) for i in range(6)]
    want += [(40 + i, f"The same {i}") for i in range(6)]
    pages += [(60, None, page(5), None, None), (61, "no address", "x", None, None), (None, "http://a.example", None, None, None), (62, "http://a.example", "", None, None), pages[0]]
    want += [(60, f"Home News About us {text(5)} All of ours"), (61, "x"), (None, ""), (62, ""), want[0]]
    assert page_text(spark, pages) == sorted(((i, t, len(t)) for i, t in want), key=repr)
    assert page_text(spark, []) == []


def test_articles_of_the_table(spark):
    """The tables' pages mark their articles: each is found whole."""
    import html as H

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in S.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in rows:
        article = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<(?:p|/p|br|h1|/h1)>", article)]
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)
    assert len(got) == len(rows)


def test_a_page_of_twenty_megabytes(spark):
    html = "<p>word &amp; word</p>" * 900_000
    assert page_text(spark, [(1, "http://a.example", html, None, None)]) == [(1, " ".join(["word & word"] * 900_000), 12 * 900_000 - 1)]
