"""Each operator on odd rows and empty tables, and against brute force on small data."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import (common, decontam, embed_lsh, hmm_lm, license_scan, line_dedup, mixing, ngram_join, pii,
                        quality_dsir, toxicity)

SPACE = r"[^\x20\x09-\x0D]+"
LABELS = "doc_id bigint, quality int, toxic int"


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


# --------------------------------------------------------------------------- odd rows, empty tables

def _runs(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None)], LABELS)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "x"), (3, "")],
                                  "item_id bigint, text string")
    return {
        "pii": lambda d: pii.digest(pii.find_pii(d)),
        "license": lambda d: license_scan.digest(license_scan.scan_licenses(d)),
        "lm": lambda d: hmm_lm.score_texts(d, rounds=2),
        "ngram": lambda d: ngram_join.join_documents(d),
        "mix": lambda d: mixing.mix_sources(d),
        "toxic": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, labels)),
        "quality": lambda d: quality_dsir.resample(quality_dsir.log_weights(d, quality_dsir.fit_log_ratio(d, labels)), 0.5),
        "lines": lambda d: line_dedup.dedup_lines(d),
        "bench": lambda d: decontam.mark_contaminated(d, bench),
    }


@pytest.mark.parametrize("name", ["pii", "license", "lm", "ngram", "mix", "toxic", "quality", "lines", "bench"])
def test_odd_rows_and_empty_table(spark, odd, none, name):
    run = _runs(spark)[name]
    rows = run(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    same = [tuple(r) for r in rows if r["doc_id"] == 1]
    assert len(same) == 2 and (name == "mix" or same[0] == same[1])
    assert run(none).count() == 0


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "q " * 20)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialize(stage(spark, docs, str(tmp_path)), "t")
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
        if start is odd:
            # 1, 1, NULL are copies and 2 has one more word (8 of 9 shingles); 5 and 7 are copies; empty texts stay
            assert sorted(r.doc_id or -1 for r in docs.select("doc_id").collect()) == [-1, 1, 3, 4, 5, 6]
            assert docs.where("doc_id = 1").select("n_lines", "score").first() == ("x", 0.5)


# --------------------------------------------------------------------------- 1, 2

def test_pii_base_equals_plain_patterns():
    rng = random.Random(3)
    bits = ["a.b@c.de", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (415) 555-0100", "+1", "@", "a@b.c@d.e", "GB82 WEST 1234 5698 7654 32", "é", "\n", " ", "12", "-", "."]
    for _ in range(400):
        t = "".join(rng.choice(bits) + rng.choice(["", " ", " card "]) for _ in range(rng.randint(0, 12)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
                 if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
                 if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                 if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
        got = [s[:3] for s in pii.scan(t) if s[0] in pii.BASE_KINDS]
        assert got == sorted(want, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert [s[0] for s in pii.scan("iban GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert not pii.scan("415-555-0100") and [s[0] for s in pii.scan("call 415-555-0100")] == ["national"]
    assert not [s for s in pii.scan("9" * 200_000) if s[0] != "card"]


def test_license_exact_and_fuzzy():
    s = license_scan.Scanner()
    n, base, spans = s.scan(b"X under the MIT license, under the mit license; CC BY-NC 4.0")
    assert n == 14 and base == [("mit", 1, 4), ("mit", 5, 8), ("cc-by-nc", 9, 11)]
    assert [x[0] for x in s.scan(b"Released undr the MIT licence.")[2]] == ["mit"]
    assert [x[0] for x in s.scan(b"GNU General Public License, version 3")[2]] == ["gpl-3"]
    assert s.scan(b"the licence of the city was granted free")[2] == [] and s.scan(b"")[0] == 0


# --------------------------------------------------------------------------- 3

def test_hmm_forward_equals_sum_over_paths():
    import itertools
    rng = np.random.default_rng(1)
    p = hmm_lm.Params(np.array([.3, .7]), np.array([.5, .5]), np.array([[.8, .2], [.4, .6]]), rng.dirichlet(np.ones(4), 2))
    for seq in ([0], [1, 2], [3, 0, 1, 2, 2, 1, 0]):
        total = 0.0
        for path in itertools.product((0, 1), repeat=len(seq)):
            q = p.start[path[0]] * p.emit[path[0], seq[0]]
            for a, b, x in zip(path, path[1:], seq[1:]):
                q *= p.move[a, b] * p.emit[b, x]
            total += q
        for stretch in (1, 3, 100):
            got = hmm_lm.log_likelihoods([np.array(seq, np.int32)], p, stretch)[0]
            assert math.isclose(got, math.log(total), rel_tol=1e-12)


def test_hmm_batches_equal_single_recursions():
    rng = np.random.default_rng(4)
    p = hmm_lm.Params(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3))
    seqs = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 70, 4, 33, 8, 8, 200, 1, 16, 17)]

    def plain(s, start):
        """Expected counts and log-likelihood by unscaled forward and backward vectors."""
        f = [start * p.emit[:, s[0]]]
        for x in s[1:]:
            f.append((f[-1] @ p.move) * p.emit[:, x])
        b = [np.ones(3)]
        for x in s[:0:-1]:
            b.insert(0, p.move @ (p.emit[:, x] * b[0]))
        total = f[-1].sum()
        xi = sum((np.outer(f[t], p.emit[:, s[t + 1]] * b[t + 1]) * p.move for t in range(len(s) - 1)), np.zeros((3, 3))) / total
        emit = np.zeros((3, 9))
        for t, x in enumerate(s):
            emit[:, x] += f[t] * b[t] / total
        return f[0] * b[0] / total, xi, emit, math.log(total)

    want = [plain(s, p.start)[3] for s in seqs]
    for stretch, head in ((5, 5), (7, 20), (16, 8), (300, 300)):
        assert np.allclose(hmm_lm.log_likelihoods(seqs, p, stretch, head), want, rtol=1e-11)
    order = sorted(seqs, key=lambda s: -len(s))
    fresh = np.array([i % 3 != 1 for i in range(len(order))])
    alone = [plain(s, p.start if f else p.cont) for s, f in zip(order, fresh)]
    for every in (1, 4, 8):
        start, cont, xi, emit, loglik = hmm_lm.expected_counts(order, fresh, p, every)
        assert np.allclose(start, sum(a[0] for a, f in zip(alone, fresh) if f))
        assert np.allclose(cont, sum(a[0] for a, f in zip(alone, fresh) if not f))
        assert np.allclose(xi, sum(a[1] for a in alone)) and np.allclose(emit, sum(a[2] for a in alone))
        assert math.isclose(loglik, sum(a[3] for a in alone), rel_tol=1e-12)


def test_hmm_production_parameters_fit_small_tables(spark):
    from pyspark.sql import functions as F
    rng = random.Random(6)
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, k=40))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # none of these is in the 1/32 that most rounds once read
    docs = docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", F.col("text").cast("binary")), F.lit(32)) != 0)
    held = [r for r in hmm_lm.score_texts(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    # two topics of equal size: a fitted model gains most of log10(2) a word
    assert sum(r.score - r.base_score for r in held) / tokens > 0.15


def test_hmm_round_without_text_keeps_parameters(spark):
    vocab = hmm_lm.Vocabulary([(b"x", 3), (b"y", 2)], 2, 4)
    p = hmm_lm.initial_params(vocab, 3, np.ones(vocab.classes))
    train = hmm_lm.class_sequences(spark.createDataFrame([], "_text binary"), vocab)
    got, loglik = hmm_lm.baum_welch_round(train, vocab, p, 16, 100)
    assert got is p and loglik == 0.0


def test_hmm_training_raises_likelihood_and_base_is_exact(spark):
    rng = random.Random(5)
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, k=40))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in hmm_lm.score_texts(docs, states=2, rounds=8).collect()}
    counts, ends = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t.split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, t in rows:
        want = sum(math.log10((c + .5) / (n + .5 * (v + 1))) for c in [*(counts[w] for w in t.split()), ends])
        assert math.isclose(got[i].base_score, want, rel_tol=1e-9) and got[i].train_tokens == n
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


# --------------------------------------------------------------------------- 4

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    vecs = [b + rng.standard_normal(16) * s for b in base for s in (0, 0.05, 0.3, 0.6)] + [base[0]] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] + [1.0] * 15), (n + 4, []), (n + 5, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in embed_lsh.near_duplicate_vectors(df, block=8).collect()}
    x = np.array([v / np.linalg.norm(v) for v in vecs])
    cos = x @ x.T
    np.fill_diagonal(cos, 0)
    link = cos >= 0.9
    found, real = sum(got[i].n_links for i in range(n)), int(link.sum())
    assert 0.9 * real <= found <= real
    clear = [i for i in range(n) if not ((cos[i] > 0.88) & (cos[i] < 0.97)).any()]
    assert clear and all(got[i].n_links == link[i].sum() for i in clear)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert embed_lsh.near_duplicate_vectors(df.limit(0)).count() == 0


# --------------------------------------------------------------------------- 5

@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join_against_brute_force(spark, n, percent):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(300)]
    shared = rng.choices(words, k=30)  # a passage many documents hold
    texts = ["", "one", "one", "one two", "one two three four"]
    for _ in range(50):
        t = rng.choices(words, k=rng.randint(3, 200))
        if rng.random() < 0.5:
            t[5:5] = shared
        for _ in range(rng.randint(1, 6)):
            u = list(t)
            for _ in range(rng.randint(0, 1 + len(u) // 40)):
                u[rng.randrange(len(u))] = rng.choice(words)
            texts.append(" ".join(u))
    rows = list(enumerate(texts))
    sets = [frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if (w := t.split()) else frozenset() for t in texts]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in ngram_join.join_documents(
        spark.createDataFrame(rows, "doc_id bigint, text string"), n=n, percent=percent).collect()}
    assert links > 30
    assert all(got[i].component_id == find(i) and got[i].n_shingles == len(sets[i]) for i in range(len(rows)))


def test_linking_sets_share_a_token():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size, percent = int(rng.integers(1, 400)), int(rng.choice([80, 85, 95]))
        a = rng.integers(0, 1 << 62, size).astype(np.uint64)
        drop = int(rng.integers(0, ngram_join._max_difference(size, percent) // 2 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 62, drop).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * len(np.union1d(a, b)):
            assert len(np.intersect1d(ngram_join.signatures(np.unique(a), percent), ngram_join.signatures(np.unique(b), percent)))


def test_chance_tokens_open_no_group(spark, monkeypatch):
    """Texts that share one passage but link with nothing hold too few common tokens for a link; near copies are kept."""
    rng = random.Random(6)
    texts = [" ".join([f"w{rng.random()}" for _ in range(10 * k)] + ["one", "two", "three", "four", "five"] + [f"w{rng.random()}" for _ in range(60)])
             for k in range(1, 40) for _ in range(4)]
    near = texts[0].split()
    near[3] = "x"
    seen = []
    keep = ngram_join._sets_for
    monkeypatch.setattr(ngram_join, "_sets_for", lambda d, t, n, wanted: seen.append(wanted.count()) or keep(d, t, n, wanted))
    df = spark.createDataFrame(list(enumerate([*texts, " ".join(near)])), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(df, n=5, percent=80).collect()}
    assert got == {i: i for i in range(len(texts))} | {len(texts): 0}
    assert seen[0] < 20


def test_components_of_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 1999), (None, 3)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(301)) and got[2000] == got[1999] == 1999


# --------------------------------------------------------------------------- 6

def test_targets_and_draws():
    t = mixing.source_targets([("a", 100), ("b", 10), (None, 50)])
    # weights 3, 1, 2 share 240: a 120, b stops at 20 (of 40), the rest is reshared
    assert t["b"] == 20 and sum(t.values()) == 240 and t[None] <= 100 and t["a"] == Fraction(220 * 3, 5)
    got = mixing.draw_shards(np.array([500, 0, 77]), 64, 100, 1)
    assert got.sum(axis=0).tolist() == [500, 0, 77] and (got.sum(axis=1) <= 64).all()
    for n in (1, 2, 3, 17, 1000):
        k = np.arange(n)
        assert sorted(mixing.permute(k, np.full(n, n), np.full(n, 9, np.uint64)).tolist()) == list(range(n))


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), rng.choice(["a", "b", "c", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    assert all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in got)
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.05 * mine[0].target
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df).collect()), key=str)


def test_mix_is_the_drawn_shards(spark):
    """Shards hold what was drawn for them, places are filled once, texts are whole blocks of their source's stream."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"{s}{i}.{j}" for j in range(rng.randint(0, 60))), s)
            for i, s in enumerate(rng.choices(["a", "b", "c"], k=120))]
    df = spark.createDataFrame(rows + [(None, None, "a")], "doc_id bigint, text string, source string")
    opts = dict(block=8, shard_slots=100)
    got = mixing.mix_blocks(df, **opts).collect()
    per = {r.doc_id: r for r in mixing.mix_sources(df, **opts).collect()}
    shards = {r.shard for r in got}
    assert len(shards) > 3 and shards == set(range(len(shards)))
    for k in shards:
        mine = sorted((r for r in got if r.shard == k), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine))) and len(mine) <= 100
        assert {r.source for r in mine[:len(mine) // 2]} == {"a", "b", "c"}  # mingled, not one source after the other
    totals = np.array([sum(r.source == s for r in got) for s in "abc"])
    drawn = mixing.draw_shards(totals, 100, 4096, 11)
    assert [[sum(r.shard == k and r.source == s for r in got) for s in "abc"] for k in sorted(shards)] == drawn.tolist()
    uses, first = Counter(), {}
    for r in got:
        words = r.text.split()
        assert len(words) == r.n_words <= 8 and all(w[0] == r.source for w in words)
        uses.update(words)
        for i in {int(w[1:].split(".")[0]) for w in words}:
            first[i] = min(first.get(i, (9e9, 0)), (r.shard, r.place))
    assert all(per[i].taken == sum(uses[w] for w in t.split()) for i, t, _ in rows)
    assert all(((per[i].first_shard, per[i].first_place) if i in first else (None, None)) == first.get(i, (None, None)) for i, _, _ in rows)
    assert max(uses.values()) <= 2


def _sent_to_driver(df):
    """Subtrees of the plan that ran, below each broadcast."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    return ["\n".join(lines[i:next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))])
            for i, x in enumerate(lines) if "BroadcastExchange" in x]


def _mixable(spark):
    return spark.createDataFrame([(i, f"w{i} " * 40, "abc"[i % 3]) for i in range(60)], "doc_id bigint, text string, source string")


def test_mix_stage_sends_no_slots_through_the_driver(spark):
    import corpus_pipeline
    sent = _sent_to_driver(corpus_pipeline.STAGES[-1][1](spark, _mixable(spark), None))
    # slots are numbered in Python; their sums by row may be broadcast, by the size that they turn out to have
    assert sent and not any("ArrowEvalPython" in x and "Aggregate" not in x for x in sent)


def test_mix_blocks_sends_neither_slots_nor_pieces_through_the_driver(spark):
    sent = _sent_to_driver(mixing.mix_blocks(_mixable(spark), block=8, shard_slots=100))
    assert sent and not any("ArrowEvalPython" in x or "Generate" in x or "_b#" in x for x in sent)


# --------------------------------------------------------------------------- 7, 8

def _labelled(spark):
    rng = random.Random(11)
    words = [f"n{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        t, bad = rng.choices(words, k=60), rng.random() < 0.2
        for _ in range(4 * bad):
            t[rng.randrange(60)] = rng.choice(["vile", "awful", "nasty"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS), labels


def test_toxicity_on_held_out(spark):
    docs, labels, truth = _labelled(spark)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    held = [(got[i], t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((s >= 0.7) == bool(t) for s, t in held) and all(0 <= s <= 1 for s, _ in held)


def test_quality_prefers_target(spark):
    docs, labels, truth = _labelled(spark)
    w = quality_dsir.log_weights(docs, quality_dsir.fit_log_ratio(docs, labels))
    got = {r.doc_id: r for r in quality_dsir.resample(w, 0.8).collect()}
    good = [got[i].selected for i, q, _ in truth if q]
    bad = [got[i].selected for i, q, _ in truth if not q]
    assert sum(r.selected for r in got.values()) == 720
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3


def test_kth_largest(spark):
    rng = random.Random(2)
    for values in ([1.0], [2.0] * 50 + [1.0], [rng.gauss(0, 1e6) for _ in range(500)], [float(i % 7) for i in range(90)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        for k in {1, 2, len(values)} - {0}:
            if k <= len(values):
                assert common.kth_largest(df, "x", k, bins=8) == sorted(values, reverse=True)[k - 1]


# --------------------------------------------------------------------------- 9, 10

def test_line_runs(spark):
    block = [f"line number {i} of a repeated passage" for i in range(5)]
    rows = [(1, "\n".join(["first", *block, "end"])), (2, "\n".join(["x", *block, "y", *block[:3], "z"])),
            (3, "\n".join(block)), (4, "a\nb\nc\na\nb\nc"), (5, "\n".join(block[:2]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "x\ny\nz" and got[2].n_removed == 8
    assert got[3].text == "" and got[4].n_removed == 0 and got[5].n_removed == 0


def test_passages_within_lines(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    sentences = " ".join(say(8).capitalize() + "." for _ in range(9))
    plain, menu = say(120), "\n".join(f"m{i}" for i in range(60))
    rows = [(1, f"{say(30)}. {sentences} {say(30)}."), (2, f"{say(20)}. {sentences} {say(20)}."),
            (3, f"{say(70)} {plain} {say(70)}"), (4, f"{say(60)}\n{say(50)} {plain} {say(50)}"), (5, sentences),
            (6, f"{menu}\nend"), (7, f"start\n{menu}\nlast"), (8, "One. Two. Three."), (9, "One. Two. Three."),
            (10, None), (12, "a single short text that is told twice, word for word"),
            (13, " \n\n"), (13, " \n\n"), (14, f"x {'so ' * 90}y"), (15, f"z {'so ' * 120}"),
            (16, "a single short text that is told twice, word for word")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    units = docs.where("text is not null").select("text", line_dedup.text_units(docs["text"]).alias("u")).collect()
    assert all("".join(r.u) == r.text for r in units)
    got = {r.doc_id: r for r in line_dedup.dedup_passages(docs).collect()}
    for i in (1, 3, 6, 8, 9, 10, 12, 13, 16):
        assert (got[i].text, got[i].n_removed) == (dict(rows)[i], 0)
    assert sentences[:60] not in got[2].text and got[2].n_removed == 9 and got[2].text == rows[1][1].replace(sentences + " ", "")
    runs = lambda t: {tuple(t.split()[i:i + 50]) for i in range(len(t.split()) - 49)}
    assert not runs(rows[2][1]) & runs(got[4].text) and set(rows[3][1].split()) - set(plain.split()) <= set(got[4].text.split())
    assert got[5].text == "" and got[7].text == "start\nlast" and not runs(got[14].text) & runs(got[15].text)
    assert got[16].text == got[12].text  # under min_passage


def test_left_neighbours_counted_by_class(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(9)))) for _ in range(200)]
    hashes = common.WordHashes()
    key = lambda w: int(hashes.array([w.encode()]).view("int64")[0])
    seen = [set(), set()]
    for y, text in rows:
        words = text.split()
        seen[y] |= set(zip([None, *words], words))
    want = {key(w): tuple(sum(b == w for _, b in s) for s in (*seen, seen[0] | seen[1])) for w in {b for s in seen for _, b in s}}
    train = spark.createDataFrame([(y, t.encode()) for y, t in rows], "_y int, _text binary")
    assert {r.b: (r.c0, r.c1, r.c) for r in toxicity._count_contexts(train).collect()} == want
    assert toxicity._count_contexts(train.limit(0)).count() == 0


def test_passages_without_emptied_rows(spark):
    text = "\n".join(f"line {i} of a passage that is told again" for i in range(6))
    rows = [(1, text, 5), (2, text, 6), (3, "its own words\n" + text, 7), (4, None, 8), (5, "", 9), (None, text, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __emptied int")
    every = {r.doc_id: r for r in line_dedup.dedup_passages(docs).collect()}
    left = {r.doc_id: r for r in line_dedup.dedup_passages(docs, units_col=None, keep_emptied=False).collect()}
    assert set(every) == {1, 2, 3, 4, 5, None} and set(left) == {1, 3, 4, 5}  # emptied rows are left out, empty ones are not
    assert all((left[i].text, left[i].n_removed, left[i]["__emptied"]) == (every[i].text, every[i].n_removed, every[i]["__emptied"])
               for i in left)
    assert left[1].text == text and left[3].text == "its own words" and "n_units" not in left[1]
    none = docs.limit(0)
    assert line_dedup.dedup_passages(none, units_col=None, keep_emptied=False).count() == 0


def test_decontamination_with_substitutions(spark):
    item = [f"t{i}" for i in range(30)]
    changed = list(item)
    changed[4] = changed[15] = changed[27] = "other"
    rows = [(1, " ".join(["a"] * 10 + item + ["b"] * 10)), (2, " ".join(["a"] * 10 + changed)), (3, " ".join(item[:9] + ["c"] * 30)),
            (4, " ".join(item[10:28])), (5, "nothing at all here")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.mark_contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, 4} and got[1].item_ids == "7" and got[1].best == 1.0
    shuffled = decontam.mark_contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench, broadcast_seeds=0)
    assert {r.doc_id for r in shuffled.collect() if r.contaminated} == {1, 2, 4}


def test_decontamination_masks_leave_no_accepted_pair_out():
    from itertools import combinations
    for n in range(5, 17):
        masks = decontam.MASKS[min(n, 8)]
        for bad in combinations(range(n), n // 5):
            assert any(all(at + k not in bad for k in m) for m in masks for at in range(n - m[-1])), (n, bad)


def test_decontamination_equals_search_without_seeds(spark):
    rng = random.Random(11)
    items = {i: [f"w{rng.randrange(400)}" for _ in range(n)] for i, n in enumerate((4, 5, 6, 7, 7, 8, 8, 9, 10, 10, 13, 15, 16, 17, 40))}
    texts = {0: None, 1: "", 2: " ".join(items[3]), 3: " ".join(items[5])}
    for doc in range(4, 400):
        words = list(rng.choice(list(items.values())))
        words = words[rng.choice((0, 0, 0, 2)):]
        for at in rng.sample(range(len(words)), min(len(words), rng.randrange(5))):
            words[at] = f"x{rng.randrange(50)}"
        fill = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(12))]
        texts[doc] = " ".join(fill[:6] + words + fill[6:])

    def agree(t, d):
        n, best = min(16, len(t)), 0.0
        for shift in range(-len(t), len(d) + 1):
            e = [t[i] == d[i + shift] for i in range(max(0, -shift), min(len(t), len(d) - shift))]
            best = max([best, *(sum(e[i:i + n]) / n for i in range(len(e) - n + 1))])
        return best

    want = {}
    for doc, text in texts.items():
        found = {i: x for i, t in items.items() if len(t) >= 5 and (x := agree(t, (text or "").split())) >= 0.8}
        want[doc] = (",".join(map(str, sorted(found))), max(found.values(), default=0.0))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.item_ids, r.best) for r in decontam.mark_contaminated(docs, bench).collect()}
    assert got == want and sum(x != "" for x, _ in want.values()) > 150 and got[2][0] == "3" and got[3][0] == "5"


def test_native_plans_hold_no_python(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id bigint, text string")
    for df in (line_dedup.dedup_lines(odd), decontam.mark_contaminated(odd, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


