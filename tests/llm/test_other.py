"""Operators on pages, vectors and conversations, and the pipeline, against brute force."""

import base64
import hashlib
import html.parser
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import chat, embdedup, extract, queries, warc
from test_documents import brute_components, brute_overlap, check_packed, prose

# --- pages ---

GOOD = "This is the text of the article and it is long enough to be good, with the words that are in it and of it, for the reader that is with us as it goes on."
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy the best of it now, it is on sale and it is for you and for all of us.</div>
<div id="cookie-notice"><p>We use the cookies of this site and of others, for that is how it is with us and with you.</p><button>OK</button></div>%s
<section id="comments"><article class="comment"><p>I think that this is the best of all and that it was good of you to say it to us as it is.</p></article></section>
<aside><p>%s</p></aside><form><label>Name</label><input></form><footer>&copy; 2020 all of it</footer></body></html>"""


@pytest.mark.parametrize("main,expected", [
    (f"<article><h1>A &amp; B</h1><p><b>{GOOD}<br><p>Short.<p>  two\n\n words </p></article>", f"A & B\n{GOOD}\nShort.\ntwo words"),
    (f"<main><h2>Head</h2><p>{GOOD}</p><ul><li><a href='1'>See this other page</a></li></ul><p>x &lt;y&gt; &#233;&nbsp;z</p></main>", f"Head\n{GOOD}\nx <y> é z"),
    (f"<div><h2>Head</h2><p>{GOOD} {GOOD}</p><p>Between.</p><p>{GOOD} {GOOD}</p></div>", f"Head\n{GOOD} {GOOD}\nBetween.\n{GOOD} {GOOD}"),
    ("<article><p>Hi</p></article>", "Hi"),
    ("<div><p>Hi</p></div>", ""),
])
def test_main_text(main, expected):
    assert extract.main_text(PAGE % (main, GOOD)) == expected


def test_malformed_pages():
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<") == ""
    assert extract.main_text(f"<nav><a>x</a><div class=ad>y<article><p>{GOOD}") == GOOD
    assert extract.main_text(f"<article><p>{GOOD}</p><p>cut <b") == GOOD + "\ncut"
    assert extract.main_text(f"<body><form id=f><div><p>{GOOD} {GOOD}</p></div></form>") == f"{GOOD} {GOOD}"
    long = " ".join(["the end of it is"] * 40_000)
    assert extract.main_text(f"<article><p>{long}</article>") == long
    assert extract.main_text("<a " * 20_000 + '"' * 20_000 + "<!--" * 5000) is not None


def test_main_texts(spark):
    rows = [(1, "u", PAGE % (f"<article><p>{GOOD}</p></article>", GOOD), 1), (2, None, None, 2), (2, "u", "", 2), (None, "v", "<p>x", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = extract.main_texts(df).collect()
    assert sorted(((r.page_id, r.text, r.n_chars) for r in got), key=str) == sorted([(1, GOOD, len(GOOD)), (2, "", 0), (2, "", 0), (None, "", 0)], key=str)
    assert extract.main_texts(df.limit(0)).count() == 0


class Plain(html.parser.HTMLParser):
    """Brute force for pages with an article: all blocks in it but those in excluded elements."""

    BLOCKS = set("p li ul ol h1 h2 h3 div article section table tr td blockquote pre figure figcaption nav aside footer header form dl dt dd".split())
    OUT = set("nav aside footer header form script style button".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.found, self.now, self.article, self.out = [], [], 0, []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.found.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
        if tag == "br":
            self.now.append(" ")
        self.article += tag == "article"
        if self.out or tag in self.OUT - ({"header"} if self.article else set()) or dict(attrs).get("class") in ("ad", "comments", "cookie-banner", "related"):
            if tag not in ("br", "img", "p", "li"):  # closed by hand in the pages below
                self.out.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        if self.out and self.out[-1] == tag:
            self.out.pop()
        self.article -= tag == "article"

    def handle_data(self, data):
        if self.article and not self.out:
            self.now.append(data)


def random_page(seed):
    """An article between menus, notices and comments, its blocks of many kinds and sizes."""
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["the", "of", "tea", "über", "x &lt; y", "&eacute;t&#233;", "3 %", "R&amp;D", "<i>it</i>", "<b>and</b>", "\n  "]) for _ in range(n))
    link = lambda n: f'<a href="/{r.random()}" title="a > b">{words(n)}.</a>'
    out = [lambda: f"<nav><ul><li>{link(2)}</li></ul></nav>", lambda: f'<div class="ad"><div>{words(30)}</div></div>', lambda: f"<aside><h3>More</h3><p>{words(40)}</p></aside>",
           lambda: f'<section class="related"><h3>x</h3><ul><li>{link(3)}</ul></section>', lambda: "<script>if (a < b) { x = '<p>no</p>' }</script>", lambda: f'<form action="/"><div>{words(5)}</div></form>',
           lambda: f'<div class="cookie-banner"><div>{words(30)}</div></div>', lambda: f"<!-- <p>{words(3)}</p> -->", lambda: "<style>p > b {}</style>"]
    own = [lambda: f"<p>{words(r.choice([1, 3, 60]))}</p>", lambda: f"<h2>{words(3)}</h2>", lambda: f"<p>See {link(4)}</p>", lambda: f"<ul><li>{words(5)}<li>{words(9)} {link(1)}</ul>", lambda: f"<p class='share-price'>{words(4)}<br>{words(2)}</p>",
           lambda: f"<blockquote><p>{words(12)}</p></blockquote>", lambda: f"<table><tr><td>{words(2)}</td><td>{words(3)}</td></tr></table>", lambda: f"<pre>{words(6)}</pre>", lambda: f"<div>{words(7)}<div>{words(2)}</div>{words(1)}</div>",
           lambda: f"<figure><img alt=\"{'x' * r.choice([3, 9000])} > \"><figcaption>{words(3)}</figcaption></figure>", lambda: f"<header><h1>{words(4)}</h1></header>"]
    body = "".join(r.choice(own)() if r.random() < 0.8 else r.choice(out)() for _ in range(r.randint(1, 25)))
    around = lambda: "".join(r.choice(out)() for _ in range(r.randint(0, 3)))
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{around()}<article>{body}</article>{around()}<div class=\"comments\"><div>{words(30)}</div></div><footer>{words(9)}</footer></body></html>"


def test_articles_match_brute_force():
    for seed in range(400):
        page = random_page(seed)
        assert extract.main_text(page) == "\n".join(Plain(page).found), (seed, page)


def test_pages_of_the_tables_match_brute_force(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test tables")
    rows = spark.read.parquet(path).collect()
    got = {r.page_id: r.text for r in extract.main_texts(spark.read.parquet(path)).collect()}
    for r in rows:
        assert got[r.page_id] == "\n".join(Plain(r.html or "").found)


def test_an_article_loses_nothing_by_links_or_neighbours():
    assert extract.main_text("<article><p>See <a>the long report on the climate</a>.</p><p>Text of it.</p></article>") == "See the long report on the climate.\nText of it."
    assert extract.main_text('<article><h1>T</h1><p>A b.</p><ul><li><a>one</a><li><a>two</a></ul><p class="related">no</p><p class="share-price">C</p></article>') == "T\nA b.\nC"
    assert extract.main_text('<article class="commentary"><p>A</p><p id="ad-slot-3">no</p><div class="post-comments">no</div><p>B</p></article>') == "A\nB"


@pytest.mark.parametrize("size", [10, 5000, 1 << 20])
def test_attributes_of_any_length(size):
    x = "x" * size
    assert extract.main_text(f'<article><p>A</p><img alt="{x}> no"><p title=\'{x}">\' class="comments">no</p><p data-a={x} class=ad>no</p><p alt="class=ad id=ad">B</article>') == "A\nB"


# --- archives ---


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\n\nhttp://x 0.0.0.0 20000101000000 text/html 5\nWARC/1.0\r\n"
    data = warc.arc_file_header(version, "a.arc", "20010203040506") + warc.arc_record(version, "http://a/b", "20010203040506", block) + warc.arc_record(version, "dns:a", "20010203040506", b"1.2.3.4")
    info, page, dns = warc.parse_arc(data)
    assert info.fields["URL"] == "filedesc://a.arc" and page.block == block and page.version == version
    archive = warc.END.join(warc.arc_to_warc(r) for r in (info, page, dns)) + warc.END
    for size in (1, 7, 1 << 20):
        found = list(warc.parse_warc(iter([archive[i : i + size] for i in range(0, len(archive), size)])))
        assert [h["warc-type"] for h, _ in found] == ["warcinfo", "response", "response"]
        assert found[1][1] == block and found[1][0]["warc-date"] == "2001-02-03T04:05:06Z"
        assert found[1][0]["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    for bad in (data[:-1], b"x" + data, data.replace(b"text/plain", b"text plain")):
        with pytest.raises((warc.ArcError, ValueError)):
            list(warc.parse_arc(bad))


def test_identifiers_hold_their_key():
    for key in (0, 1, -1, 2**62, 2**63 - 1, -(2**63), 12345):
        assert warc.urn_key(warc.key_urn(key)) == key
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", warc.key_urn(key))
    assert warc.urn_key("<urn:uuid:00000000-0000-4000-8000-000000000000>") is None


@pytest.mark.parametrize("broadcast", [16 << 20, -1])
def test_archive_round_trip(spark, tmp_path, broadcast):
    pages = [(1, "http://a b", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "ü\r\n\r\nWARC/1.1\r\n" * 50), (6, "u", "x" * 300_000), (7, "u", "one"), (7, "u", "one"), (6, "u", "one"), (None, "u", "one")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, sha1 string")
    warc.pages_to_warc(df, str(tmp_path / "w"), broadcast_bytes=broadcast)
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    best = {}
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    shared = {h for _, _, h in pages if sum((x or "") == (h or "") for _, _, x in pages) > 1}
    want = []
    for i, _, h in pages:
        h = h or ""
        again = (h in shared or h == "") and i != best[h]
        raw = h.encode()
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", best[h] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.payload_ok for r in got)
    assert {r.url for r in got} == {"http://a%20b", "-", "u"}
    warc.pages_to_warc(df.coalesce(1), str(tmp_path / "small"), file_bytes=100_000)
    assert len(list((tmp_path / "small").glob("part*"))) >= 3 and warc.read_warc(spark, str(tmp_path / "small")).count() == len(pages)
    warc.pages_to_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
    small = warc.shared_payloads(df, least_bytes=4)
    assert [r.response for r in small.collect()] == [2]


def test_convert_arc_files(spark, tmp_path):
    data = warc.arc_file_header(2, "a.arc", "20010203040506") + b"".join(warc.arc_record(2, f"http://a/{i}", "20010203040506", warc.page_block(i, b"p%d" % i)) for i in range(20))
    (tmp_path / "a.arc").write_bytes(data)
    warc.convert_arc_files(spark, str(tmp_path / "a.arc"), str(tmp_path / "out"))
    assert {r.page_id for r in warc.read_warc(spark, str(tmp_path / "out")).collect()} == set(range(20))


# --- vectors ---


def vector_rows():
    rng, rows = np.random.default_rng(8), []
    for c in range(25):
        base = rng.normal(size=64)
        for _ in range(c):
            rows.append((len(rows), (base + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.16])).tolist(), c % 3))
    base = rows[50][1]
    rows += [(1000 + i, base, 1) for i in range(5)] + [(1010, [2 * x for x in base], 1), (1011, base, 2), (1012, base, None), (1013, None, 1), (1014, [0.0] * 64, 1), (1015, [None, *base[1:]], 1)]
    return rows + [(1016, [float("nan"), *base[1:]], 1), (1017, [float("inf"), *base[1:]], 1), (1018, [], 1), (1019, base[:32], 1), (1020, base[:32], 1), (None, base, 1), (1003, base, 1), (1021, [x * 1e200 for x in base], 1)]


def test_near_vectors_match_brute_force(spark, monkeypatch):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, c, 1, "k") for i, v, c in rows], "vec_id long, embedding array<double>, label int, node int, key string")
    ok = [i is not None and c is not None and v is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.array(v, float)).all()) and any(v) for i, v, c in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if o else None for (_, v, _), o in zip(rows, ok)]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a + 1, n):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                if x != y:
                    x, y = sorted((x, y), key=lambda k: rows[k][0])
                    root[y] = x
    want = sorted(((rows[i][0], links[i], rows[find(i)][0]) for i in range(n)), key=str)
    for block in (embdedup.BLOCK, 16):
        monkeypatch.setattr(embdedup, "BLOCK", block)
        got = embdedup.near_vectors(df).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert embdedup.near_vectors(df.limit(0)).count() == 0


def test_each_pair_counts_in_one_table():
    rng = np.random.default_rng(10)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        x = np.array([[sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(n)]], dtype=np.uint64)
        met = [t for t in range(2 * n) if not (int(x[0, t // 2]) >> (32 * (t % 2))) & 0xFFFFFFFF]
        first = embdedup._counts_here(np.repeat(x, 2 * n, axis=0), np.arange(2 * n))
        assert first.sum() == bool(met) and (not met or first[met[0]])


# --- conversations ---


def conversation_rows():
    r = random.Random(12)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "[", "<\\/s>", "[\\\\INST]", "é", "\n", "ok", ""]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "q"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, 1, "assistant", None), (None, 0, "assistant", "a")]
    rows += [(10 + c, t, r.choice(["user", "assistant", "system", "[INST]"]), "".join(r.choice(bits) for _ in range(6))) for c in range(40) for t in range(r.randint(1, 7))]
    return rows + [(100, t, "assistant" if t % 2 else "user", "long " * 5000) for t in range(8)]


def test_chat_round_trip(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    texts = {}
    for i, t, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2] or "", x[3] or "")):
        texts.setdefault(i, []).append((role or "", text or ""))
    assert got.keys() == texts.keys()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, turns in texts.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[i].n_turns, got[i].turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), sha(loss))
    for r in made.collect():
        inside = re.split(r"<s>|\[INST\]|</s>", r.formatted)
        assert not any("[/INST]" in x for x in inside)
        if r.loss_start is not None:
            assert r.formatted[r.loss_start + r.loss_chars :] == "</s>"
    assert made.where("conv_id = 100").count() == 4
    assert chat.digests(chat.examples(df.limit(0))).count() == 0
    assert not re.search("Python|Pandas|Arrow", chat.digests(made)._jdf.queryExecution().executedPlan().toString())


# --- pipeline ---


def test_pipeline_matches_brute_force(spark, tmp_path):
    words = {"en": "the and of to in that is was for with", "de": "der die und nicht ein das mit sich auf den"}
    r = random.Random(13)
    rows = []
    for i in range(160):
        lang = r.choice(["en", "de"])
        rows.append((i, " ".join(w + r.choice(["", "", prose(i * 7 + k, 1)]) for k, w in enumerate(r.choices(words[lang].split(), k=60))) + "\nshared footer of the site", lang, f"h{i % 2}"))
    bench = [(0, prose(77, 30))]
    rows[5] = (5, "the and of " + bench[0][1] + "\nshared footer of the site", "en", "h1")
    rows += [(1000, "12 34 ??", "en", "h0"), (1001, None, "en", "h0"), (1002, rows[0][1], "en", "h0"), (1003, rows[1][1] + " more", "de", "h1")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, frame = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in list(stage)[:-1]:
        frame = stage[name](spark, frame, str(tmp_path))
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    kept = {x[0]: x[1].removesuffix("\nshared footer of the site") for x in rows if x[1] and re.search("[a-z]", x[1])}
    kept[1003] = rows[1][1] + " more"
    roots, _ = brute_components(sorted(kept.items()), 80)
    want = {i: t for i, t in kept.items() if roots[i] == i and not brute_overlap(t, [("0", bench[0][1])])[1]}
    got = {x.doc_id: x for x in frame.collect()}
    assert {i: x.text for i, x in got.items()} == want and all(x.n_chars == len(x.text) for x in got.values())
    assert 0 in got and not {5, 1000, 1001, 1002, 1003} & set(got)
    check_packed(sorted(want.items()), corpus_pipeline.run(spark, str(tmp_path)).collect())


def odd_documents(spark):
    """Rows with nulls in any column, empty and very long texts, ties, repeats, and columns with clashing names."""
    long = prose(99, 30_000)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the and of to in that is was", "en", "s", 1), (3, long, "en", None, 1), (4, long, None, "s", 1), (4, long, None, "s", 1), (5, "12 ??", "en", "", 1), (6, "one line\none line\n\n", "de", "s", 1)]
    rows += [(10 + i, f"der die und nicht {prose(i, 30)}\nfoot", "de", "s", 1) for i in range(30)]
    return spark.createDataFrame([(*x, 7, "x", True) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, cluster string, near boolean")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_on_none(spark, tmp_path, name):
    spark.createDataFrame([(0, prose(3, 25)), (None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df, stage = odd_documents(spark), dict(corpus_pipeline.STAGES)[name]
    rows = df.collect()
    out = stage(spark, df, str(tmp_path))
    got = out.collect()
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    if name == "packing":
        return check_packed([(r.doc_id, r.text) for r in rows], got)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    count = lambda xs: sorted((str(r.doc_id) for r in xs))
    if name == "language_id":
        assert count(got) == count(r for r in rows if r.text and re.search("[a-z]", r.text))
    elif name == "line_dedup":
        texts = {r.doc_id: r.text for r in got}
        assert count(got) == count(rows) and texts[1] is None and texts[2] == "" and texts[10] == f"der die und nicht {prose(0, 30)}"
        assert texts[6] == "one line\none line\n\n" and texts[3] == texts[4] == prose(99, 30_000)
    elif name == "minhash_near_dedup":
        assert count(got) == count(r for r in rows if r.doc_id != 4)
    else:
        assert count(got) == count(r for r in rows if not brute_overlap(r.text, [("0", prose(3, 25))])[1])
    return None


def test_queries_are_registered():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
