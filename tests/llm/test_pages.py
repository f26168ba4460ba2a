"""The page operators against brute force, and on odd rows."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tablelens.llm import archives, url_filter, wrappers
from tablelens.llm.common import read_table

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"
BIG = "<p>" + "same words again " * 100 + "</p>"
ODD = [
    (1, None, None), (None, "http://a.org/x", "<p>one</p>"), (None, "http://a.org/x", "<p>one</p>"), (2, "no scheme", ""), (3, "http://", "   "),
    (4, "http://a.org/x", BIG), (5, "http://b.org/y", BIG), (5, "http://b.org/y", BIG), (6, "http://c.com/", BIG), (None, "http://c.com/", BIG),
    (7, "HTTP://User@Sub.Example.ORG:80?q", "<article><p>A &amp; B&nbsp;c<br>d</p><footer>x</footer></article>"), (8, "x://y#z", "<p>" + "long " * 60_000 + "</p>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, PAGES)
    return df.withColumns({c: F.lit("mine") for c in "host path rule verdict ratio key text skeleton main payload digest sha action __row".split()})


@pytest.fixture(scope="module")
def pages(spark):
    return read_table(spark, SF, "pages")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], PAGES)


# ---------------------------------------------------------- 3: extraction

SITE = """<!DOCTYPE html><html><head><title>t</title><body><header>Site</header><nav class=x><ul><li><a href="/a">A</a></li>{menu}</ul></nav>
<div class="cookie-notice">Cookies!</div><aside>Side</aside><article><h1>Title &lt;{n}&gt;</h1>{body}<form>Name <input></form><script>var a="<p>no</p>";</script>
<!-- <p>hidden</p> --><div class="comments"><p>Nice!</p></div></article><div id="sidebar">more</div><footer>&copy; me</footer></body></html>"""


def test_extraction(spark, pages, odd, empty):
    made = []
    for n in range(8):
        body = "".join(f"<p>Par {n}.{k}\n  <b>bold</b>text</p>" for k in range(n)) + ("<ul><li>one</li><li>two</li></ul>" if n % 2 else "<p>unclosed <i>it")
        made.append((n, "http://site.org/a", SITE.format(menu="<li><a>M</a></li>" * n, n=n, body=body)))
    got = {r["page_id"]: r["text"] for r in wrappers.pages_table(spark.createDataFrame(made, PAGES)).collect()}
    for n in range(8):
        want = [f"Title <{n}>", *[f"Par {n}.{k} boldtext" for k in range(n)], *(["one", "two"] if n % 2 else ["unclosed it"])]
        assert got[n] == "\n".join(want), (n, got[n])
    # no element names the article: text that differs between the pages of a host
    plain = [(n, "http://plain.org/", f"<div><div class=menu>Menu</div><h2>Welcome to us</h2><div>News {n}</div><div class=ad>Buy</div></div>") for n in range(6)]
    assert {r["text"] for r in wrappers.pages_table(spark.createDataFrame(plain, PAGES)).collect()} == {f"News {n}" for n in range(6)}
    rows = wrappers.pages_table(odd).collect()
    assert len(rows) == len(ODD)
    texts = {(r["page_id"], r["n_chars"]): r["text"] for r in rows}
    assert texts[1, 0] == texts[2, 0] == texts[3, 0] == "" and texts[7, 9] == "A & B c d" and texts[8, 299_999].startswith("long long")
    assert wrappers.pages_table(empty).collect() == []


def texts_of(spark, made):
    return {r["page_id"]: r["text"] for r in wrappers.pages_table(spark.createDataFrame(made, PAGES)).collect()}


def test_extraction_keeps_what_one_page_or_only_copies_hold(spark):
    once = ["<ul><li>lone item</li></ul>", "<table><tr><td>lone cell</td></tr></table>", "<h3>lone head</h3>", "<blockquote>lone quote</blockquote>", "", ""]
    made = [(n, "http://plain.org/", f"<div><h2>Welcome to us</h2><p>News {n}</p>{more}</div>") for n, more in enumerate(once)]
    # a page and its copy share what no other page has
    made += [(n, "http://plain.org/", "<div><h2>Welcome to us</h2><p>Twice</p><dl><dt>lone term</dt></dl></div>") for n in (6, 7)]
    lone = ["lone item", "lone cell", "lone head", "lone quote", None, None]
    want = {n: f"News {n}" + (f"\n{x}" if x else "") for n, x in enumerate(lone)}
    assert texts_of(spark, made) == want | {6: "Twice\nlone term", 7: "Twice\nlone term"}
    # copies alone, also under different navigation
    made = [(n, "http://copy.org/", f"<nav>Page {n}</nav><div><h2>Head</h2><p>Body</p></div>") for n in range(7)]
    assert set(texts_of(spark, made).values()) == {"Head\nBody"}


def test_extraction_on_hosts_with_several_templates(spark):
    kinds = ["<article><p>{}</p></article>", "<main><p>{}</p></main>", "<div class=content><p>{}</p></div>", "<p>{}</p>", "<div class=content><p>{}</p></div><aside><article>Read also</article></aside>"]
    for url in ("http://two.org/", None):
        made = [(n, url, f"<body><div>Our site</div>{kinds[n % 5].format(f'Text {n}')}<div>Made by us</div></body>") for n in range(15)]
        assert texts_of(spark, made) == {n: f"Text {n}" for n in range(15)}


def test_blanks_between_inline_elements():
    for source, want in (
        ("<p><b>one</b> <i>two</i></p>", "one two"), ("<p><b>one</b><i>two</i></p>", "onetwo"), ("<p> <a>x</a>\n\t<a>y</a> <!-- c --> z</p> <p>next</p>", "x y z\nnext"),
        ("<p>one<!-- c --> <script>s</script>two</p>", "one two"), ("<div><b>a</b> <div> <i>b</i> </div> <i>c</i></div>", "a\nb\nc"),
    ):
        text, _, stream, texts = wrappers.skeleton(source)
        assert wrappers.page_blocks(stream, texts, [True] * len(texts)) == want, source
        assert text == wrappers.skeleton(source.replace("> <", "><"))[0]
    stream, texts = wrappers.tokens("<p><b>one</b> <q>left out</q><i>two</i></p>")
    assert wrappers.page_blocks(stream, texts, [True, False, True]) == "one two"


def test_extraction_by_shuffle_agrees(spark, pages, monkeypatch):
    want = sorted(map(tuple, wrappers.pages_table(pages).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, wrappers.pages_table(pages).collect())) == want
    assert len(want) == pages.count() and all(n == len(t) > 0 for _, _, t, n in want)


def test_wrapper_takes_in_every_page():
    one, _ = wrappers.fold("<ul> <li> # </li> <li> # </li> </ul> <p> # </p>".split())
    two, _ = wrappers.fold("<ul> <li> # </li> <li> # </li> <li> # </li> </ul> <h1> # </h1> <p> # </p>".split())
    assert one == ["<ul>", ["+", ["<li>", "#", "</li>"]], "</ul>", "<p>", "#", "</p>"]
    wrapper, maps = wrappers.infer([one, two])
    assert wrapper == ["<ul>", ["+", ["<li>", "#", "</li>"]], "</ul>", ["?", ["<h1>", "#", "</h1>"]], "<p>", "#", "</p>"]
    assert maps == [[0, 2], [0, 1, 2]]
    again, mine, _ = wrappers.generalise(wrapper, one)
    assert sum(map(wrappers.slots_in, again)) == 3 and mine == [0, 1, 2]


def test_broken_html():
    for source in ("<", "<p", "</p>", "<a href='x>text", "<!-- open", "<script>never", "a < b > c", "<p>x</div></p>", "<head><title>t</title><body>real"):
        text, owner, stream, texts = wrappers.skeleton(source)
        assert stream.count("#") == len(texts) == len(owner)
    assert wrappers.skeleton("<head><title>t</title><body>real")[3] == ["real"]


# ------------------------------------------------------------- 5: archives


def test_archives(spark, pages, odd, empty):
    both = pages.select("page_id", "url", "html").unionByName(odd.select("page_id", "url", "html"))
    data = [(i, (h or "").encode()) for i, _, h in both.collect()]
    keeper = {}
    for i, raw in data:
        if i is not None:
            keeper[raw] = max(i, keeper.get(raw, i))
    want = []
    for i, raw in data:
        again = len(raw) >= 1000 and raw in keeper and keeper[raw] != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keeper[raw] if again else None))
    got = [tuple(r) for r in archives.archive_table(both).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert archives.archive_table(empty).collect() == []


class Whole:
    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def read_at(self, length, offset):
        self.read += length
        return self.raw[offset : offset + length]


@pytest.mark.parametrize("big", [False, True])
def test_zip_directories(big):
    members = [("archive/data.warc", b"x" * 300_000), ("indexes/index.tsv", b"0\t5\n"), ("leer-\u00fc", b"")]
    raw = b"".join(archives.zip_bytes(members, zip64=big))
    with zipfile.ZipFile(io.BytesIO(raw)) as other:  # another reader agrees
        assert other.testzip() is None and [(i.filename, other.read(i)) for i in other.infolist()] == members
    source = Whole(raw)
    found = archives.read_members(source, len(raw))
    assert {n: raw[m.start : m.start + m.size] for n, m in found.items()} == dict(members)
    assert source.read < 70_000


def test_all_archive_members_are_read(tmp_path):
    import pyarrow as pa

    made = []
    for stem, keys in (("one", "12"), ("two", "345"), ("data", "6")):
        records = [archives.record_bytes(k, "http://a.org/", k.encode(), hashlib.sha1(k.encode()).hexdigest(), 1, None) for k in keys]
        starts = [sum(map(len, records[:i])) for i in range(len(records))]
        index = "".join(f"{a}\t{len(r)}\n" for a, r in zip(starts, records))
        made += [(f"archive/{stem}.warc", b"".join(records)), (f"indexes/{'index' if stem == 'data' else stem}.tsv", index.encode())]
    (tmp_path / "a.wacz").write_bytes(b"".join(archives.zip_bytes([*made, ("other", b"x")])))
    paths = pa.RecordBatch.from_arrays([pa.array([str(tmp_path / "a.wacz")])], names=["path"])
    assert sorted(k for b in archives._read(iter([paths])) for k in b.column(0).to_pylist()) == list("123456")
    with pytest.raises(ValueError, match="do not belong"):
        archives.archive_pairs(["archive/a.warc", "archive/b.warc", "indexes/a.tsv"])


def test_foreign_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("a", "w", force_zip64=True) as member:
            member.write(b"hello")
        z.comment = b"note PK\x05\x06 in it"
    raw = out.getvalue()
    (member,) = archives.read_members(Whole(raw), len(raw)).values()
    assert raw[member.start : member.start + member.size] == b"hello"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"hello" * 100)
    with pytest.raises(ValueError, match="not stored"):
        archives.read_members(Whole(out.getvalue()), len(out.getvalue()))
    with pytest.raises(ValueError, match="not a ZIP"):
        archives.read_members(Whole(b"nothing"), 7)


# ----------------------------------------------------------- 9: URL filter


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def rule_of(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_filter(spark, pages, odd, empty):
    both = pages.select("page_id", "url").unionByName(odd.select("page_id", "url"))
    got = url_filter.judge(both).toPandas().astype(object).where(lambda d: d.notna(), None)
    assert len(got) == both.count()
    for r in got.itertuples():
        host, path = split_url(r.url)
        rule, action = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict in ("allow", "block") and (action is None or r.verdict == action)
    assert url_filter.url_table(empty).collect() == []
    assert {r["verdict"] for r in url_filter.url_table(odd.filter("page_id = 2")).collect()} == {"allow"}


def test_url_ratios_by_brute_force(spark, pages):
    from collections import Counter
    from math import log

    rows = url_filter.judge(pages.select("page_id", "url")).collect()
    n = url_filter.ORDER
    folds = {r["page_id"]: r["f"] for r in pages.select("page_id", F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)).alias("f")).collect()}
    grams = lambda u: [("\x02" * n + u + "\x03")[i : i + n + 1] for i in range(len(u) + 1)]
    symbols = len({g[-1] for r in rows for g in grams(r["url"])})
    counts = {k: Counter(g for r in rows if r["action"] == k and folds[r["page_id"]] for g in grams(r["url"])) for k in ("allow", "block")}
    tails = {k: [Counter() for _ in range(n + 1)] for k in counts}
    for k, c in counts.items():
        for g, m in c.items():
            for o in range(n + 1):
                tails[k][o][g[n - o :]] += m
    known = {k: [(Counter(), Counter()) for _ in range(n + 1)] for k in counts}
    for k in counts:
        for o in range(n + 1):
            for t, m in tails[k][o].items():
                known[k][o][0][t[:-1]] += m
                known[k][o][1][t[:-1]] += 1

    def p(k, g):
        out = 1 / symbols
        for o in range(n + 1):
            t = g[n - o :]
            total, kinds = (x[t[:-1]] for x in known[k][o])
            if total:
                out = (tails[k][o][t] + kinds * out) / (total + kinds)
        return out

    for r in rows:
        g = grams(r["url"])
        assert abs(sum(log(p("allow", x)) - log(p("block", x)) for x in g) / len(g) - r["ratio"]) < 1e-9
