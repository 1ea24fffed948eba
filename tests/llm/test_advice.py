
import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import embdedup, extract
from test_documents import docs, prose

# --- pipeline: near copies count as one page ---


def test_a_group_of_near_copies_keeps_its_text_once(spark, tmp_path):
    page = [prose(1000 + k, 9) for k in range(12)]
    r = random.Random(1)
    rows = [(1, "\n".join([*page, "the footer"]))]
    for i in range(2, 62):
        lines = list(page)
        k = r.randrange(12)
        lines[k] = " ".join([*lines[k].split()[:-1], f"changed{i}"])
        rows.append((i, "\n".join([*lines, "the footer"])))
    rows += [(100 + i, prose(i, 40) + "\nthe footer") for i in range(140)]
    rows += [(300 + i, "the footer\n") for i in range(4)]
    df = docs(spark, rows)
    stage = dict(corpus_pipeline.STAGES)
    stripped = stage["line_dedup"](spark, df, str(tmp_path))
    assert stripped.columns == df.columns
    texts = {x.doc_id: x.text for x in stripped.collect()}
    assert texts[1] == "\n".join(page) and texts[100] == prose(0, 40)
    assert all(len(texts[i].split("\n")) == 12 for i in range(1, 62))
    assert texts[300] == "the footer\n"  # boilerplate only: stays, and the next stage keeps one
    left = {x.doc_id for x in stage["minhash_near_dedup"](spark, stripped, str(tmp_path)).collect()}
    assert left == {1, 300} | {100 + i for i in range(140)}


# --- op5_embedding_near_dedup: recall with a common mean ---


def sample_of(kind, n=8000):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 64))
    if kind == "tight":  # 80 % in one group
        x[: n * 4 // 5] = rng.normal(size=64) + 0.15 * x[: n * 4 // 5]
    elif kind == "flat":  # variances that fall off
        x *= 0.9 ** np.arange(64)
    elif kind == "groups":
        x = rng.normal(size=(50, 64))[rng.integers(0, 50, n)] + 0.3 * x
    elif kind == "sparse":
        x *= rng.random(x.shape) < 0.1
        x[:, 0] += 1e-3
    elif kind:
        x += kind * rng.normal(size=64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", [0, 1.25, 1.8, 2.5, "tight", "flat", "groups", "sparse"])
def test_recall_at_the_threshold(kind):
    """Of pairs at just the threshold, apart in any direction or in those of the data."""
    x = sample_of(kind)
    made = embdedup.enough({64: x}, 0.98)[64]
    assert embdedup.rotations(0.98) <= len(made) <= embdedup.MOST
    for seed in (77, 78):
        for a, b in embdedup.threshold_pairs(x, 0.98, seed=seed):
            met = np.zeros(len(a), dtype=bool)
            for r in made:
                met |= ((r.codes(a) ^ r.codes(b)).view(np.uint32).reshape(-1, 2) == 0).any(axis=1)
            assert met.mean() > 0.98


@pytest.mark.parametrize("kind", [2.5, "groups", "flat"])
def test_links_against_brute_force(spark, kind):
    """Vectors of one label with many pairs about the threshold."""
    x = sample_of(kind, 400)
    rng = np.random.default_rng(3)
    noise = rng.normal(size=x.shape) * rng.uniform(0.05, 0.25, (400, 1)) / 8
    x = np.concatenate([x, x + noise])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    want = int((sim >= 0.98).sum()) - len(x)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embdedup.near_vectors(df).collect()
    links = sum(r.n_links for r in got)
    assert want > 200 and 0.98 * want <= links <= want


# --- op3_html_extraction: text in plain div and p, of any language ---

RU = "Вчера вечером в городе прошёл сильный дождь, многие улицы оказались под водой, жители ждали помощи до утра."
ES = "Ayer llovió mucho cerca de Madrid; varias calles quedaron cubiertas de agua, vecinos esperaron ayuda hasta hoy."


@pytest.mark.parametrize("text", [RU, ES])
def test_text_outside_an_article_in_any_language(text):
    page = "<body><nav><a href=/>Menu</a></nav><div>%s</div><p>Buy <a href=/b>this very good thing and that very good thing of the same shop.</a></p><footer>all of it</footer>"
    two, three = f"{text} {text}", f"{text} {text} {text}"
    assert extract.main_text(page % f"<p>{two}</p><p>{text}</p><p>{three}</p>") == f"{two}\n{text}\n{three}"
    assert extract.main_text(page % f"<p>{two}</p>") == two
    assert extract.main_text(page % f"<p>{text}</p>") == text
