"""Operators on documents against brute force, with the odd cases: nulls, empty and very long
texts, repeated rows, empty tables, columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import decontaminate, langid, linededup, minhash, packing, pii

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, kept boolean"


def docs(spark, texts, source="s", lang="en"):
    rows = [(i, t, lang, source, 1, 5, "k", True) for i, t in texts]
    return spark.createDataFrame(rows, EXTRA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = prose(99, 60_000)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, LONG), (7, LONG), (7, LONG), (8, "äöü " * 20), (None, "one two")]


# --- near duplicates ---


def shingle_set(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def near_rows():
    r = random.Random(3)
    rows, n = list(ODD), 100
    for family in range(12):
        base = prose(family, r.choice([12, 40, 200])).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = "changed" + str(r.randint(0, 9))
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(900 + i, prose(7, 30)) for i in range(20)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, percent):
    rows = near_rows()
    want, sets = brute_components(rows, percent)
    got = minhash.near_duplicates(docs(spark, rows), percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_blocks_change_no_component(spark, monkeypatch):
    rows = [(i, " ".join(prose(5, 100).split()[:95] + [f"x{i % 37}"])) for i in range(90)]
    want, _ = brute_components(rows, 80)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 8)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 80).collect()} == want


@pytest.mark.parametrize("rows_, texts_, size_", [(3, 3, 8 << 20), (2048, 4, 8 << 20), (5, 512, 2000)])
def test_hot_groups_meet_a_pivot_first(spark, monkeypatch, rows_, texts_, size_):
    """Groups over a block of a few families, bridges between them, and rows that no pivot is near to."""
    r = random.Random(8)
    rows = near_rows()
    for family in range(3):
        w = prose(40 + family, 60).split()
        for i in range(40):  # a walk: each is near to the one before, few to the first
            w[r.randrange(60)] = f"step{family}{i}"
            rows.append((2000 + 100 * family + i, " ".join(w)))
    want, _ = brute_components(rows, 80)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", texts_)
    monkeypatch.setattr(minhash, "BLOCK_TEXT_BYTES", size_)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs(spark, rows), 80).collect() if x.doc_id is not None}
    assert got == want and len({want[2000 + i] for i in range(40)}) < 40


def test_deduplicate_keeps_columns_and_one_of_each_group(spark):
    df = docs(spark, near_rows())
    want, _ = brute_components(near_rows(), 80)
    out = minhash.deduplicate(df, 80)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} - {None} == set(want.values())
    assert minhash.near_duplicates(df.limit(0), 80).count() == 0


def test_reach_covers_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    for p in (0.8, 0.85):
        assert (rng.binomial(minhash.SIZE, 1 - p, 200_000) > minhash.reach(p)).mean() < 3e-4


# --- decontamination ---

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def word_list(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_overlap(t, items):
    w, hit, found = word_list(t), set(), []
    for name, text in items:
        v = word_list(text)
        n = min(10, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        at = [i for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in grams]
        hit.update(j for i in at for j in range(i, i + n))
        if at:
            found.append(name)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def contaminated():
    items = [(str(i), prose(200 + i, 25)) for i in range(12)] + [("100", "tiny phrase"), ("101", "..."), ("102", None), ("103", prose(203, 25)), ("104", "a b c d e f g h i")]
    rows = list(ODD)
    for i in range(12):
        w = items[i][1].split()
        rows.append((50 + i, " ".join([prose(i, 20), *w[i : i + 8 + i % 5], prose(i + 1, 20), "Tiny, PHRASE!" if i % 3 == 0 else "tiny"])))
    rows += [(80, "tiny phrase"), (81, "a b c d e f g h i"), (82, " ".join(["x"] * 50)), (83, LONG + " " + items[3][1])]
    return rows, items


@pytest.mark.parametrize("block_words", [1 << 20, 60])
def test_overlaps_match_brute_force(spark, block_words):
    rows, items = contaminated()
    bench = spark.createDataFrame([(int(i), t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.overlaps(docs(spark, rows), bench, block_words=block_words).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *brute_overlap(t, items)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got), key=str) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    clean = decontaminate.decontaminate(docs(spark, rows), bench, block_words=block_words)
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, n, h, k, s in want if not h), key=str)


@pytest.mark.parametrize("block_words", [1 << 20, 300])
def test_an_item_of_many_rows_and_a_long_one(spark, block_words):
    """Blocks are cut inside an item_id and inside a text; nothing is lost or made up."""
    long = prose(700, 3000)
    items = [("7", prose(600 + i, 30)) for i in range(60)] + [("", prose(660 + i, 12)) for i in range(40)] + [("8", long), ("8", prose(1, 3))]
    w = long.split()
    rows = [(i, " ".join([prose(i, 15), *w[i * 37 : i * 37 + 8 + i % 6], prose(i + 1, 15), *items[i][1].split()[3 : 11 + i % 4]])) for i in range(70)] + [(100, long), (101, " ".join(w[290:320])), (102, None)]
    bench = spark.createDataFrame([(int(i) if i else None, t) for i, t in items], "item_id long, text string")
    n_blocks = len(list(decontaminate.item_blocks(bench, block_words)))
    assert n_blocks == 1 if block_words > 300 else n_blocks > 20
    want = []
    for i, t in rows:
        n, hit, found = len(word_list(t)), set(), set()
        for name, text in items:
            one = brute_positions(t, text)
            hit |= one
            found |= {name} if one else set()
        want.append((i, n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    got = decontaminate.overlaps(docs(spark, rows), bench, block_words=block_words).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == sorted(want)
    clean = {r.doc_id for r in decontaminate.decontaminate(docs(spark, rows), bench, block_words=block_words).collect()}
    assert clean == {i for i, _, h, *_ in want if not h}


def brute_positions(t, text):
    w, v = word_list(t), word_list(text)
    n = min(10, len(v))
    grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
    return {j for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in grams for j in range(i, i + n)}


def test_overlaps_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs(spark, ODD), bench).where("contaminated").count() == 0
    assert decontaminate.overlaps(docs(spark, ODD).limit(0), bench).count() == 0


def test_winnowing_keeps_a_print_of_every_window():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 20, 200).astype(np.uint64)
    prints = set(decontaminate.fingerprints(g, 200 - np.arange(200), 5, 10).tolist())
    for i in range(191):
        assert prints & set(range(i, i + 6))


# --- line dedup ---


def brute_strip(rows, ratio, least):
    """rows: (doc_id, source, text); every row is a page."""
    pages, on = {}, {}
    for _, host, t in rows:
        pages[host] = pages.get(host, 0) + 1
        for x in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            on[host, x] = on.get((host, x), 0) + 1
    gone = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, h, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (h, x.strip(" \t\r")) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("ratio, least", [(0.3, 5), (0.05, 2), (0.9, 2)])
def test_line_dedup(spark, ratio, least):
    rows = [(i, "s", f"Menu \nunique {i}\n\nFooter") for i in range(20)] + [(100 + i, "s", "Copy\nof a page\nFooter") for i in range(30)] + [(200, "s", None), (201, "s", ""), (202, "s", "Menu\nFooter"), (203, "s", LONG)]
    rows += [(300 + i, None, "Menu\nalone\nalone") for i in range(3)] + [(7, "t", "twice\tx"), (7, "t", "twice\tx"), (None, "t", "one\ntwo"), (None, "t", "one\nthree"), (401, "u", "a page\nof its host"), (402, "", "null source is another\nMenu")]
    df = spark.createDataFrame([(i, t, "en", s, 1, 5, "k", True, "h") for i, s, t in rows], EXTRA + ", _ld_host string")
    out = linededup.strip_lines(df, ratio, least, counts=("n_lines", "n_dropped"))
    want = brute_strip(rows, ratio, least)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    plain = linededup.strip_lines(df, ratio, least, broadcast_bytes=-1)
    assert plain.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in plain.collect()), key=str) == sorted(((w[0], w[3]) for w in want), key=str)
    assert linededup.strip_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        linededup.strip_lines(df, counts=("node", "x"))


def test_line_dedup_counts_a_group_once(spark):
    page = "\n".join(prose(k, 9) for k in range(5))
    rows = [(i, "s", page + "\nfoot") for i in range(30)] + [(100 + i, "s", f"{prose(50 + i, 9)}\nfoot") for i in range(30)] + [(None, "s", page)]
    df = spark.createDataFrame([(i, t, "en", s, 1, 5, "k", True) for i, s, t in rows], EXTRA)
    groups = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, near long")
    texts = {r.doc_id: r.text for r in linededup.strip_lines(df, 0.1, groups=groups).collect()}
    assert texts[3] == page and texts[100] == prose(50, 9) and texts[None] == page  # 2 of 32 pages


# --- personal data ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def pii_rows():
    fixed = [
        "mail a.b+c@x-y.example.com, or a@b.c_d@e.f and x@y.z@w.v", "a@b", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0001.02.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "4111111111111111 12", "call +1 (555) 123-4567. or +49 30 1234567 ext", "+1 2", "é" * 5 + " 10.0.0.1 ü 4111111111111111", "card 378282246310005 here", "number 378282246310005",
        "IBAN DE89 3704 0044 0532 0130 00 ok", "GB82WEST12345698765432", "GB83WEST12345698765432", "a@b.c " * 700, "9" * 50_000, "a" * 200_000 + "@", "1 " * 40_000, "+1((((" * 3000,
    ]
    r = random.Random(11)
    alphabet = "ab@.c1234567890 +-()_%é "
    return list(enumerate([*fixed, *("".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(1500))], 1000)) + ODD


def test_pii_matches_brute_force(spark):
    rows = pii_rows()
    got = pii.digests(pii.find(docs(spark, rows))).collect()
    want = sorted(((i, hashlib.sha256(",".join(brute_spans(t)).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == want
    by = {r.doc_id: r for r in got}
    assert by[1000 + 13].n_email == 700
    assert by[1000 + 8].spans == "card_short:5:20" and by[1000 + 9].spans == ""
    assert by[1000 + 10].spans == "iban:5:32" and by[1000 + 11].spans == "iban:0:22" and by[1000 + 12].n_added == 0
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.digests(pii.find(docs(spark, rows).limit(0))).count() == 0


def test_pii_runs_no_python(spark):
    plan = pii.digests(pii.find(docs(spark, ODD)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- packing ---


def test_combinations_fill_the_window():
    table = packing.combinations(16)
    assert (np.arange(17) @ table == 16).all() and (table.sum(axis=0) >= 2).all()


def test_nnls_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.normal(size=12)
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-6).all() and np.abs(gain[x > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("lengths", [[], [1], [4095] * 40, [1500] * 300, list(range(1, 4096)), [10] * 5000, [2049] * 50])
def test_packer_places_every_token_once(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    made = packing.Packer().sequences(lengths) if len(lengths) else []
    pieces, padding = {}, 0
    for s in made:
        total = sum(n for _, _, n in s)
        assert 0 < total <= 4096
        padding += 0 if total & (total - 1) == 0 else 4096 - total
        for p, start, n in s:
            pieces.setdefault(p, []).append((start, n))
    for p, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces[p]):
            assert start == at
            at += k
        assert at == n
    assert padding <= 0.03 * lengths.sum()


def check_packed(rows, found):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for _, t in rows]
    want, at = {}, {}
    for (i, _), x in zip(rows, ids):
        want.setdefault((i, len(x)), []).append(x)
    for r in found:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in want[r.doc_id, r.doc_tokens])
    for s in at.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 4096
    assert sum(r.length for r in found) == sum(map(len, ids))


@pytest.mark.parametrize("block", [packing.BLOCK_TOKENS, 5000])
def test_pack(spark, block):
    rows = [*ODD, *((100 + i, prose(i, 40 * i)) for i in range(30)), (500, "It's <|endoftext|> don't… ÀÉ! x²½ 12,5"), (501, "w" * 3000)]
    check_packed(rows, packing.pack(docs(spark, rows), block_tokens=block).collect())
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


# --- language ---


def language_rows(n=300):
    words = {"aa": "the and of to in that is was for with".split(), "bb": "der die und nicht ein das mit sich auf für".split(), "cc": "el la que y en los del las una por".split()}
    r = random.Random(4)
    return [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(5, 120))), lang) for i in range(n) for lang in [r.choice(list(words))]]


def test_language_held_out_accuracy(spark):
    rows = language_rows()
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows] + [(1000, "123 ... ", "aa", "s"), (1001, None, "aa", "s"), (1002, "١٢٣", "aa", "s"), (1003, "", None, "s"), (None, "der die und nicht " * 9, "bb", "s"), (1004, "der die das " * 50_000, None, "s")],
                               "doc_id long, text string, lang string, score string")
    net = langid.train(df, sample_docs=240)
    got = {r.doc_id: r for r in langid.identify(df, net).collect()}
    assert len(got) == df.count()
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002, 1003))
    assert got[1004].lang_pred == "bb" and got[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_languages(df, net, 0.3)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got) - {1000, 1001, 1002, 1003}
    assert langid.train(df.where("lang = 'zz'")) is None
    assert langid.identify(df, None).where("lang_pred <> 'und'").count() == 0


def test_language_is_learned_from_no_held_out_row(spark):
    rows = [(i, "x y z", f"only{i}") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0] + [(i, "q r s", "seen") for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["seen"]


def test_tables_give_the_convolution():
    rng = np.random.default_rng(5)
    net = langid.ByteNet(["a", "b", "c"], window=32)
    net._start(rng)
    net.folded()
    x = langid.FOLD[rng.integers(0, 256, (7, 32))]
    e, w = net.weights["embed"][x], net.weights
    h = [np.maximum(sum(e[:, j : 32 - k + 1 + j] @ w[f"filter{k}"][j] for j in range(k)).max(axis=1) + w[f"shift{k}"], 0) for k in net.widths]
    z = np.concatenate(h, axis=1) @ w["out"] + w["bias"]
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(x), want, atol=1e-5)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(6)
    net = langid.ByteNet(["a", "b"], depth=3, filters=2, window=12)
    net._start(rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = langid.FOLD[rng.integers(97, 110, (4, 12))], np.array([0, 1, 1, 0])

    def loss():
        e, w = net.weights["embed"][x], net.weights
        h = [np.maximum(sum(e[:, j : 12 - k + 1 + j] @ w[f"filter{k}"][j] for j in range(k)).max(axis=1) + w[f"shift{k}"], 0) for k in net.widths]
        p = langid._softmax(np.concatenate(h, axis=1) @ w["out"] + w["bias"])
        return -np.log(p[np.arange(4), y]).mean()

    grad = net._gradient(x, y)
    for name, g in grad.items():
        flat = net.weights[name].reshape(-1)
        for i in rng.choice(flat.size, min(6, flat.size), replace=False):
            keep, step = flat[i], 1e-6
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert (up - down) / (2 * step) == pytest.approx(np.asarray(g).reshape(-1)[i], abs=1e-5)


def test_buckets_of_a_group_link_to_one_node():
    """A group that shares many buckets has as many different links as members, not as buckets."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, keys = 300, 64
    node = np.concatenate([rng.permutation(n) for _ in range(keys)])
    key = np.repeat(np.arange(keys), n)
    zero = pa.array(np.zeros(n * keys, np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(key), zero, zero, pa.array(node), zero, pa.array([bytes(64)] * (n * keys), pa.binary())], ["key", "bi", "bj", "node", "own", "sig"])
    links = {(a, b) for out in minhash._within(20, 8)(iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
    assert links == {(i, 0) for i in range(1, n)}


def test_wide_signatures(spark):
    rows = near_rows()
    want, _ = brute_components(rows, 80)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 80, bits=16).collect() if r.doc_id is not None} == want


def test_every_language_can_be_predicted(spark):
    """No number of languages is too many; each has a word of its own."""
    rows = [(i, f"{prose(5000 + i % 250, 1)} " * 12, f"l{i % 250:03d}") for i in range(250 * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df, sample_docs=500, sample_windows=1, window=48)
    assert len(net.languages) == 250
    got = langid.identify(df, net).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len({r.lang_pred for r in got}) > 230 and np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_language_of_a_document_is_the_mean_of_its_windows(spark):
    """Windows cut at fixed bytes, weighted by letters; ties go to the language that sorts first."""
    net = langid.train(spark.createDataFrame([(i, t, lang) for i, t, lang in language_rows(200)], "doc_id long, text string, lang string"), sample_docs=100)
    texts = [prose(3, 400), "der " * 64 + "12 34 " * 200 + "the of", "ä" * 300 + " x", "."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(df, net).collect():
        raw = texts[r.doc_id].encode()
        total, mass = np.zeros(len(net.languages)), 0
        for at in range(0, len(raw), net.window):
            w = langid.FOLD[np.frombuffer(raw[at : at + net.window].ljust(net.window), np.uint8)]
            letters = int((w != 32).sum())
            total, mass = total + letters * net.probabilities(w[None])[0], mass + letters
        if not mass:
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred == net.languages[total.argmax()] and r.score == pytest.approx(total.max() / mass, abs=1e-5)
    even = langid.ByteNet(["b", "a"], weights={k: np.zeros_like(v) for k, v in net.weights.items()})
    even.weights |= {"out": np.zeros((48, 2), np.float32), "bias": np.zeros(2, np.float32)}
    even.languages = ["a", "b"]
    assert {(r.lang_pred, r.score) for r in langid.identify(df.limit(2), even).collect()} == {("a", 0.5)}
