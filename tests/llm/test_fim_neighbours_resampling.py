"""Fill-in-middle, NN-descent and target resampling: odd rows, empty tables, and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import fim, nn_descent, target_resample

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --------------------------------------------------------------------------- fill in the middle

def fim_of(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not t or any(m in t for m in fim.SENTINELS):
        return len(units), "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return len(units), form, len(p), len(m), sha(out), sha(t)


@pytest.mark.parametrize("block", [3, 4096])
def test_fim_against_regular_expression(spark, block):
    rng = random.Random(7)
    bits = ["a", "é", "日本", "\n", "\n\n", "x y z", "<", "S>", "<P", "\r\n", "\U0001F600"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, "a<M>b"), (1001, "<S"), (1002, "line\n" * 50_000 + "end"), (None, "no id\nhere"), (1003, None), (1004, ""), (1004, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in fim.digest(fim.fill_in_middle(df, block=block)).collect())
    assert got == Counter((i, *fim_of(i, t)) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_rates(spark):
    df = spark.createDataFrame([(i, "one\ntwo\nthree") for i in range(400)], "doc_id bigint, text string")
    forms = Counter(r.form for r in fim.fill_in_middle(df, fim_rate=30, spm_rate=100).collect())
    assert set(forms) == {"plain", "spm"} and 80 <= forms["spm"] <= 160


# --------------------------------------------------------------------------- resampling

def resample_of(docs, target, share=(5, 100), min_words=20):
    def runs(t):
        w = WORD.findall(low(t or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    raw = Counter(b for _, t in docs for b in runs(t)[1])
    want = Counter(b for t in target for b in runs(t)[1])
    s_all, t_all = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s_all + 10_000) / ((raw[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, t in docs:
        n, found = runs(t)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[:share[0] * len(able) // share[1]]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Été", "ÄB", "日本", "x-y", "A1"]
    return [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 25, 90])))) for i in range(n)]


@pytest.mark.parametrize("share", [(5, 100), (100, 100), (0, 100)])
def test_resample_against_brute_force(spark, share, monkeypatch):
    monkeypatch.setattr(target_resample, "_CHUNK", 50)
    monkeypatch.setattr(target_resample, "_PIECE", 64)
    docs = corpus(3, 400) + [(900, None), (901, ""), (902, "long text " * 20_000)]
    target = [t for _, t in corpus(4, 30)] + [None, ""]
    got = target_resample.resample_to_target(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                             spark.createDataFrame([(t,) for t in target], "text string"), share=share).collect()
    rows, drawn = resample_of(docs, target, share)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got) == sorted(map(tuple, rows))
    ranks = {r.doc_id: r["rank"] for r in got if r["rank"] is not None}
    assert ranks == {r[0]: k for k, r in enumerate(drawn, 1)}


def test_resample_ties_and_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(25))
    docs = [(7, text)] * 300 + [(None, text)] * 300 + [(i, text) for i in range(100, 130)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = target_resample.resample_to_target(df, df, share=(50, 100)).collect()
    rows, drawn = resample_of(docs, [t for _, t in docs], (50, 100))
    assert Counter(r.doc_id for r in got if r["rank"]) == Counter(r[0] for r in drawn)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 316))
    by_rank = [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert by_rank == [r[0] for r in drawn] and len(got) == 630


@pytest.mark.parametrize("ids", [[3, 5, 5, 9, -2, 40], [1] * 6])
def test_cut_among_equal_scores(spark, ids):
    rows = [(i, 30, 1, 10, 10) for i in ids] + [(99, 30, 1, 20, 20), (98, 5, 1, 50, 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    for k in range(8):
        got = target_resample.draw(df, (k, 7)).collect()
        want = [99, *sorted(ids)][:k]
        assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want and len(got) == 8


def test_bisection_finds_every_cut():
    for high in (0, 1, 5, 1000, 1 << 62):
        for want in {0, high // 3, high}:
            calls = []
            assert target_resample.bisect_counts(lambda cs: [calls.append(cs), [c <= want for c in cs]][1], 0, high) == want
            assert len(calls) <= 17


def test_crc_of_runs_from_words():
    rng = random.Random(1)
    shift = target_resample.Shift()
    for _ in range(200):
        a, b = (bytes(rng.choices(range(256), k=rng.randint(0, 700))) for _ in range(2))
        got = shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
        assert got[0] == zlib.crc32(a + b)


# --------------------------------------------------------------------------- neighbours

def brute(rows, k, wanted):
    use = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in use:
        if wanted(q):
            found = sorted(((-float(use[q] @ v), i) for i, v in use.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_neighbours_odd_rows_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same) for i in range(100)] + [(i, (rng.standard_normal(8) * rng.uniform(0.2, 5)).tolist()) for i in range(100, 200)]
    odd = [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [None] + [1.0] * 7), (280, []), (300, [float("inf")] * 8),
           (None, same), (100, rows[100][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id bigint, embedding array<double>, rank int, score string")
    want, got = brute(rows, 20, lambda i: i % 20 == 0), answers(nn_descent.nearest_vectors(df, width=120, beam=120))
    assert {q: [i for i, _ in a] for q, a in got.items()} == {q: [i for i, _ in a] for q, a in want.items()}
    assert all(math.isclose(x[1], y[1], rel_tol=1e-12) for q in want for x, y in zip(got[q], want[q]))
    few = spark.createDataFrame(rows[98:103], "vec_id bigint, embedding array<double>")
    assert {q: len(a) for q, a in answers(nn_descent.nearest_vectors(few)).items()} == {100: 4}
    assert nn_descent.nearest_vectors(df.limit(0)).count() == 0
    assert nn_descent.nearest_vectors(df.where("vec_id in (200, 240)")).count() == 0


def test_descent_and_search_recall(spark):
    """Blocks far smaller than the table, so that links come from the descent; norms differ."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.7 * rng.standard_normal((3000, 16))
    x *= rng.uniform(0.8, 1.25, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    graph = nn_descent.build_graph(df, block=128, trees=3)
    assert graph.rounds >= 2
    lists = graph.links.groupBy("u").count().collect()
    assert len(lists) == 3000 and all(r["count"] <= 40 for r in lists)
    got = answers(nn_descent.nearest_vectors(df, block=128, trees=3))
    want = brute(rows, 20, lambda i: i % 20 == 0)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)


def test_small_tables_take_the_same_steps(spark, monkeypatch):
    """A table under one block's size: as many trees and links a block as any other, and a descent."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(90)], "vec_id bigint, embedding array<double>")
    trees, per_block, first = [], [], nn_descent._first_links
    monkeypatch.setattr(nn_descent, "_first_links", lambda c, b, p: trees.append(len(c.first()["cells"])) or per_block.append(p) or first(c, b, p))
    graph = nn_descent.build_graph(df, block=128, trees=3)
    assert graph.rounds >= 1 and trees == [3]
    nn_descent.build_graph(df, block=16, trees=3)
    assert trees == [3, 3] and per_block[0] == per_block[1]
