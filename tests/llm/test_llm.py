"""Training-data operators on small fixtures against brute force, and their edge cases."""

import hashlib
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import ann, attention, decontam, graph, jaccard, lmscore, mixing, quality, secrets, sharding, substrings, toxicity
from tesserae.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row long, skey string"
RNG = np.random.default_rng(3)
PIECES = "ba ce di fo gu ha ke li mo nu pa re si to vu".split()


def prose(words, rng=RNG):
    return " ".join("".join(rng.choice(PIECES, rng.integers(1, 4))) for _ in range(words))


def table(spark, rows):
    """Documents with extra columns whose names clash with inner ones; rows are (id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "x", 7, "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGE = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "two words"), (5, "long " * 30000), (6, "é漢字 " * 40), (-7, "tie"), (8, "tie", None)]


# sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding_is_the_jump_hash(spark):
    rows = [(i, prose(3)) for i in range(400)] + EDGE
    got = sharding.assign_shards(table(spark, rows), 24).collect()
    assert len(got) == len(rows)
    for r in got:
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25))
        assert r.grown_shard in (r.shard, 24)
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    one = next(r for r in got if r.doc_id == 6)
    assert one.size == len(EDGE[7][1].encode()) + 8 and one.text_crc32 == zlib.crc32(EDGE[7][1].encode())
    assert sharding.assign_shards(table(spark, [])).count() == 0


# mixing


def water(sizes, weights, cap=3.0):
    total, target, capped = sum(sizes), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        free = sum(w for w, c in zip(weights, capped) if not c)
        left = total - sum(cap * s for s, c in zip(sizes, capped) if c)
        target = [cap * s if c else left * w / free for s, w, c in zip(sizes, weights, capped)]
        over = [t > cap * s and not c for t, s, c in zip(target, sizes, capped)]
        if not any(over):
            return target
        capped = [c or o for c, o in zip(capped, over)]


def test_mixing_meets_targets(spark):
    sources = [("b", 3), ("a", 2), (None, 9), ("c", 120), ("d", 60)]
    rows = [(i, prose(int(RNG.integers(0, 40))), s) for s, n in sources for i in range(n)] + [(5, None, "a"), (5, "", "b")]
    got = mixing.mix_documents(table(spark, rows), block_words=16).collect()
    assert len(got) == len(rows)
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in order]
    for s, size, target in zip(order, sizes, water(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])):
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(target) for r in mine)
        assert sum(r.taken for r in mine) == round(target)
        assert all(r.taken <= 3 * r.size for r in mine)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_documents(table(spark, rows[::-1]), block_words=16).collect()), key=str)
    assert mixing.mix_documents(table(spark, [])).count() == 0
    assert mixing.mix_documents(table(spark, EDGE)).count() == len(EDGE)


def test_mixing_is_spread_evenly(spark):
    rows = [(i, prose(64), s) for s, n in (("a", 50), ("b", 50)) for i in range(n)]
    placed = mixing.place(table(spark, rows))
    plan = mixing.materialise(mixing.source_targets(placed, block_words=16))
    slots = mixing.slot_schedule(plan).orderBy("time").collect()
    half = Counter(r.skey for r in slots[: len(slots) // 2])
    whole = Counter(r.skey for r in slots)
    assert all(abs(2 * half[s] - whole[s]) <= 12 for s in whole)


# secrets


def test_base_spans_and_counts(spark):
    key, token = "AKIA" + "Q7" * 8, "tok" + "en"
    texts = [
        f"a {key} b {key.lower()} {token}=abcdefgh {token}: short1", "pass" + "word='" + "Zz9" * 5 + "' é漢 " + "0f" * 20, f"{token}=pass" + "word: abcdefghijk", "nothing to see here_at_all_really",
        f"API_KEY = x{'y' * 9}", "AKIA" + "B" * 11 + " " + "a" * 31, f"{token}=={'a' * 8}", None, "", "x" * 50000 + " " + "ab12" * 9,
    ]
    got = {r.doc_id: r for r in secrets.span_digest(secrets.scan_secrets(table(spark, list(enumerate(texts))))).collect()}
    rules = (
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    for i, text in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in p.finditer(text or "") if ok(m))
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), i
        assert [got[i][n] for n in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))


def test_markov_tells_random_from_ordinary(spark):
    random = [hashlib.sha1(b"t%d" % i).hexdigest()[:24] for i in range(20)] + secrets.random_samples(400)[-40:]
    ordinary = ["load_configuration_from_file", "BackgroundTaskSchedulerFactory", "internationalization", "www_example_com_index_page", "4111111111111111", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    got = {r.doc_id: r.n_added + r.n_hex for r in secrets.span_digest(secrets.scan_secrets(table(spark, list(enumerate(f"see {x} there" for x in random + ordinary))))).collect()}
    assert sum(got[i] > 0 for i in range(len(random))) >= 0.95 * len(random)
    assert not any(got[len(random) + i] for i in range(len(ordinary)))


# decontamination


def test_leaks_survive_substitutions(spark):
    items = [prose(30) for _ in range(6)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(9, None, "x"), (10, "", "x"), (11, "four words only here", "x")], "item_id long, text string, seed string")
    changed = items[1].split()
    for k in (3, 11, 17, 26):
        changed[k] = "zz"
    rows = [
        (0, f"{prose(50)} {items[0].upper()}! {prose(20)}"), (1, f"{prose(33)} {' '.join(changed)} {prose(9)}"), (2, prose(300)),
        (3, f"{prose(10)} {' '.join(items[2].split()[:24])} {prose(10)}"), (4, f"{items[3]} {items[4]}"), (4, "again"), (5, f"{prose(2000)} {items[5]}"), *[(i + 10 if i is not None else None, *x) for i, *x in EDGE],
    ]
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(table(spark, rows), bench).collect()}
    assert got == {(0, 0), (1, 1), (3, 2), (4, 3), (4, 4), (5, 5)}
    assert decontam.find_leaks(table(spark, []), bench).count() == 0
    assert decontam.find_leaks(table(spark, rows), bench.where("false")).count() == 0


def test_every_accepted_overlap_is_found(spark):
    sizes = (16, 15, 10, 9, 4, 1)
    items = {n: prose(n).split() for n in sizes}
    items[1] = ["onlyone"]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    rows, pairs = [], set()
    for n, tokens in items.items():
        for wrong in combinations(range(n), n - -(-n * 4 // 5)):
            for before in (4, 5):
                pairs.add((len(rows), n))
                rows.append((len(rows), " ".join(["q"] * before + ["z" if k in wrong else t for k, t in enumerate(tokens)] + ["y"] * 3)))
    rows += [(len(rows), " ".join(["q"] * 4 + ["z" if k in (1, 5, 9, 13) else t for k, t in enumerate(items[16])])), (len(rows) + 1, " ".join(items[4][:3]))]
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(table(spark, rows), bench).collect()} == pairs


# substrings


def test_repeated_passages(spark):
    passages = [prose(60) for _ in range(5)]
    rows = [(i, f"{prose(80)} {passages[i % 5]} {prose(int(RNG.integers(1, 90)))}") for i in range(20)] + [(100 + i, prose(200)) for i in range(20)]
    rows += [(200, rows[25][1]), (201, None), (202, ""), (203, "short"), (203, "short")]
    got = substrings.find_repeats(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(5, 20)) | {200}
    text = dict((i, t) for i, t, *_ in rows)
    for r in got:
        part = text[r.doc_id][r.start : r.end]
        assert part in text[r.first_doc_id] and r.words >= substrings.LEAST_WORDS
        if r.doc_id < 20:
            assert part in f" {passages[r.doc_id % 5]} "
    assert substrings.find_repeats(table(spark, [])).count() == 0


def test_chunks_resist_shifts_and_cover_the_text():
    data = np.frombuffer(prose(3000).encode(), dtype=np.uint8)
    one, two = substrings.chunk_ends(data), substrings.chunk_ends(np.concatenate([data[:100], np.frombuffer(b"inserted", dtype=np.uint8), data[100:]]))
    pieces = lambda d, e: {d[a:b].tobytes() for a, b in zip([0, *e], e)}
    assert one[-1] == len(data) and np.diff(one, prepend=0).max() <= substrings.LONGEST
    assert len(pieces(data, one) & pieces(np.concatenate([data[:100], np.frombuffer(b"inserted", dtype=np.uint8), data[100:]]), two)) >= len(pieces(data, one)) - 6
    slow = 0
    for b in data[:500]:
        slow = (2 * slow + int(substrings.GEAR[b])) % 2**32
    assert slow == int(substrings.gear_hash(data[:500])[-1])
    assert len(substrings.chunk_ends(np.zeros(0, np.uint8))) == 0


# neighbours


def test_neighbours_against_brute_force(spark):
    centres = RNG.normal(size=(12, 16))
    X = centres[RNG.integers(0, 12, 1500)] + 0.3 * RNG.normal(size=(1500, 16))
    X[40:140] = X[40]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(X)]
    bad = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [], 1), (2100, [1.0], 1), (None, rows[0][1], 1)]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, leaf int")
    got = ann.search(t).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(range(0, 1500, 20))
    hits = 0
    for q, rs in found.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in {r.vec_id for r in rs}
        assert rs == sorted(rs, key=lambda r: (-r.score, r.vec_id))
        assert all(r.score == pytest.approx(float(X[q] @ X[r.vec_id]), abs=1e-12) for r in rs)
        scores = (X * X[q]).sum(axis=1)
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -scores))[:20]) & {r.vec_id for r in rs})
    assert hits >= 0.9 * 20 * len(found)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>, leaf int")
    assert sorted((r.query_id, r["rank"]) for r in ann.search(few).collect()) == [(0, k) for k in (1, 2, 3, 4)]
    assert ann.search(t.where("false")).count() == 0


# similarity join


def brute_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if w and i is not None:
            sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), []).append(i)
    keys = list(sets)
    parent, links = list(range(len(keys))), [0] * len(keys)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if 9 * len(keys[a] & keys[b]) >= 4 * (len(keys[a]) + len(keys[b])):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(keys)):
        groups.setdefault(find(a), []).extend(sets[keys[a]])
    return {(i, min(groups[find(a)]), links[a]) for a, k in enumerate(keys) for i in sets[k]}


def edited(text, k, rng):
    words = text.split()
    for i in rng.choice(len(words), k, replace=False):
        words[i] = "edit" + str(rng.integers(1000))
    return " ".join(words)


def test_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    base, passage = [prose(150, rng) for _ in range(8)], prose(60, rng)
    rows = [(i, edited(base[i % 8], int(rng.integers(0, 6)), rng)) for i in range(60)] + [(100 + i, edited(base[0], 2, rng)) for i in range(60)]
    rows += [(300 + i, f"{passage} {prose(60, rng)}") for i in range(30)] + [(400 + i, rows[i][1]) for i in range(20)]
    rows += [(i + 900 if i is not None else None, *x) for i, *x in EDGE]
    got = jaccard.join_similar(table(spark, rows)).collect()
    assert len(got) == len(rows)
    real = {(r.doc_id, r.class_id, r.n_links) for r in got}
    assert brute_classes(rows) <= real
    assert {(901, 901, 0), (902, 902, 0), (903, 903, 0), (None, None, 0)} <= real
    assert jaccard.join_similar(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, 101), (101, 102), (103, 102), (7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 10 for k in range(10, 61)} | {k: 100 for k in range(100, 104)}


# language model


def test_attention_gradient_and_scores():
    rng = np.random.default_rng(1)
    ids, valid = rng.integers(0, 50, (3, attention.WINDOW)).astype(np.int32), np.ones((3, attention.WINDOW), bool)
    valid[0, : attention.WINDOW - attention.STRIDE] = False
    target = rng.integers(-1, attention.CLASSES, (3, attention.STRIDE))
    flat = attention.initial(np.zeros(attention.CLASSES, np.float32)).astype(np.float64)
    _, g = attention.loss_and_gradient(flat, ids, valid, target)
    for k in [*np.argsort(-np.abs(g))[:12], *(np.flatnonzero(g)[::997])[:40]]:
        step = np.zeros_like(flat)
        step[k] = 1e-5
        slope = (attention.loss_and_gradient(flat + step, ids, valid, target)[0] - attention.loss_and_gradient(flat - step, ids, valid, target)[0]) / 2e-5
        assert g[k] == pytest.approx(slope, rel=2e-3, abs=2e-6)
    target = np.maximum(target, 0)
    scores = attention.Scorer(flat.astype(np.float32)).block_scores(ids, valid, target)
    loss, _ = attention.loss_and_gradient(flat, ids, valid, target)
    assert -scores.mean() == pytest.approx(loss, rel=1e-4)
    later = ids.copy()
    later[:, -1] += 1  # the last input cannot change what was scored before it
    assert np.allclose(attention.Scorer(flat.astype(np.float32)).block_scores(later, valid, target)[:, :-1], scores[:, :-1])


def test_attention_steps_keep_their_memory():
    """Pages that each step of training gets anew from the system took half of its time."""
    code = (
        "import resource, numpy as np; from tesserae.llm import attention as A; rng = np.random.default_rng(0)\n"
        "ids, valid, target = rng.integers(0, A.INPUTS, (2560, A.WINDOW)), np.ones((2560, A.WINDOW), bool), rng.integers(0, A.CLASSES, (2560, A.STRIDE))\n"
        "learner = A.Learner(A.initial(np.zeros(A.CLASSES, np.float32)), rate=0.002); learner.learn(ids, valid, target)\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt; learner.learn(ids, valid, target)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 40)"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert float(done.stdout) < 50  # a step


def some_windows(n):
    rng = np.random.default_rng(6)
    ids, valid = rng.integers(0, attention.INPUTS, (n, attention.WINDOW)).astype(np.int32), np.ones((n, attention.WINDOW), bool)
    valid[::3, : attention.WINDOW - attention.STRIDE] = False
    return attention.initial(np.zeros(attention.CLASSES, np.float32)), ids, valid, rng.integers(-1, attention.CLASSES, (n, attention.STRIDE)).astype(np.int32)


def test_graphs_agree_with_numpy():
    pytest.importorskip("onnxruntime")
    flat, ids, valid, target = some_windows(64)
    gradient, scorer = graph.fastest()
    assert (gradient, scorer) == (graph.gradient, graph.Scorer)
    for some in (slice(None), slice(1, 2), slice(0, 1)):
        want = attention.numpy_gradient(flat, ids[some], valid[some], target[some])
        assert np.allclose(gradient(flat, ids[some], valid[some], target[some]), want, rtol=1e-3, atol=1e-5 * np.abs(want).max())
    assert not gradient(flat, ids, valid, np.full_like(target, -1)).any()
    target = np.maximum(target, 0)
    assert np.allclose(scorer(flat).block_scores(ids, valid, target), attention.Scorer(flat).block_scores(ids, valid, target), atol=1e-5)


def test_training_takes_the_faster_gradient():
    """A step in numpy took about twice as long as a graph's, so half a GB was not learnt from in time."""
    pytest.importorskip("onnxruntime")
    given, took = some_windows(64), {}
    for gradient in (attention.numpy_gradient, graph.fastest()[0]) * 12:
        began = time.perf_counter()
        gradient(*given)
        took[gradient] = min(took.get(gradient, 9), time.perf_counter() - began)
    assert took[graph.fastest()[0]] < 0.8 * took[attention.numpy_gradient]


def test_words_are_encoded_together_and_laid_out():
    with open(lmscore.TOKENIZER, "rb") as f:
        encoder = lmscore.Encoder(f.read())
    texts = ["", "x", "naïve 数据 zq9x# " + "y" * 90 + " \u3000 a\u00a0b 1234567890123", *(prose(n, np.random.default_rng(n)) for n in (1, 15, 16, 17, 300))]
    words = [w for t in texts for w in lmscore.words_of(t)]
    every = "".join(map(chr, [*range(1, 0x3100), 0xFEFF, 0x1F600])) + " a\x0bB\x1cC\x85d\x00e"
    assert all([w.decode() for w in lmscore.byte_words(t)] == lmscore.words_of(t) for t in [*texts, every])
    found, lengths = encoder.encode_all([w.encode() for w in [*words, "z"]])
    each = [encoder.encode(" " + w) for w in [*words, "z"]]
    assert found.tolist() == [x for e in each for x in e] and lengths.tolist() == list(map(len, each))
    assert encoder.encode_all(["a\ud800".encode("utf-8", "surrogatepass"), b"b"])[1].tolist() == [len(encoder.encode(" a\ud800")), 1]
    n = len(encoder.bytes) + 1
    v = lmscore.Vocabulary(b"", n - 1, np.arange(n) % attention.INPUTS, np.arange(n) % attention.CLASSES, np.zeros(n), np.zeros(attention.CLASSES), np.zeros((3, 0)))
    laid, at = lmscore.lay_out([encoder.word_ids(lmscore.byte_words(t)) for t in texts], encoder, v), 0
    for k, text in enumerate(texts):
        stream = np.array([v.end, *(x for w in lmscore.words_of(text) for x in encoder.encode(" " + w)), v.end])
        blocks = -(-(len(stream) - 1) // attention.STRIDE)
        inputs, valid, target = lmscore.windows_of(stream, v, np.arange(blocks))
        got = laid.windows(at, at + blocks)
        known = target >= 0
        assert (laid.of[at : at + blocks] == k).all() and (got[1] == valid).all()
        assert (got[2] == np.where(known, v.klass[target], -1)).all()
        late = attention.WINDOW - attention.STRIDE
        assert (got[0][:, :late][valid[:, :late]] == inputs[:, :late][valid[:, :late]]).all() and (got[0][:, late:][known] == inputs[:, late:][known]).all()
        at += blocks
    assert at == len(laid.late)


def test_attention_holds_large_logits():
    rng = np.random.default_rng(4)
    flat = attention.initial(np.zeros(attention.CLASSES, np.float32))
    ids, valid, target = rng.integers(0, attention.INPUTS, (40, attention.WINDOW)), np.ones((40, attention.WINDOW), bool), rng.integers(0, attention.CLASSES, (40, attention.STRIDE))
    attention.unpack(flat)["U"][:] *= 2000
    loss, grad = attention.loss_and_gradient(flat, ids, valid, target)
    assert np.isfinite(loss) and np.isfinite(grad).all() and np.isfinite(attention.Scorer(flat).block_scores(ids, valid, target)).all()


def test_lm_scores(spark):
    rng = np.random.default_rng(8)
    rows = [(i, prose(int(rng.integers(1, 60)), rng)) for i in range(150)] + [(i + 500 if i is not None else None, *x) for i, *x in EDGE]
    got = lmscore.score_texts(table(spark, rows)).collect()
    assert len(got) == len(rows)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t, *_ in rows)
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    long = {r.doc_id: r.score for r in got}
    assert long[505] < long[504]
    assert lmscore.score_texts(table(spark, [])).count() == 0


def test_hot_ids_are_numbered_and_placed_whole(spark):
    rows = [(None, f"a b {i % 50}" if i % 3 else None) for i in range(600)] + [(7, "w " * (i % 9)) for i in range(500)] + [(i, "x y z", "b") for i in range(100)]
    got = sharding.assign_shards(table(spark, rows)).toPandas()
    assert len(got) == len(rows)
    for _, some in got.groupby("shard"):
        assert sorted(some["slot"]) == list(range(len(some)))
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"])) == want
    placed = mixing.place(table(spark, rows)).toPandas()
    assert len(placed) == len(rows)
    for _, some in placed.groupby("source"):
        some = some.sort_values(["start", "size"])
        assert (some["start"].to_numpy() == np.cumsum(some["size"].to_numpy()) - some["size"].to_numpy()).all()


def test_subwords_of_a_class_sum_to_one(spark):
    texts = [prose(200) for _ in range(30)] + ["naïve 数据 zq9x#", ""]
    counts = lmscore.count_words(table(spark, list(enumerate(texts))), "doc_id", "text")
    with open(lmscore.TOKENIZER, "rb") as f:
        v = lmscore.build_vocabulary(counts, f.read())
    after, share = v.after()
    every = np.arange(v.end + 1)
    befores = sorted({int(np.flatnonzero(v.input_id == b)[0]) for b in [*v.pairs[0][:200], 0, attention.INPUTS - 1]})
    for before in befores:
        stream = np.stack([np.full(len(every), before), every], axis=1).ravel()
        inside = v.inside(stream, after, share)[1::2].astype(np.float64)
        assert np.allclose(np.bincount(v.klass, np.exp(inside), attention.CLASSES)[np.unique(v.klass)], 1, atol=2e-4)


def test_training_reads_every_subword(spark):
    texts = [prose(5000), "", "one", "x" * 30000, prose(40)]
    counts = lmscore.count_words(table(spark, list(enumerate(texts))), "doc_id", "text")
    with open(lmscore.TOKENIZER, "rb") as f:
        v = lmscore.build_vocabulary(counts, f.read())
    encoder = lmscore.Encoder(v.ranks)
    want = sorted(int(v.klass[i]) for t in texts for i in [x for w in lmscore.words_of(t) for x in encoder.encode(" " + w)] + [v.end])
    got = np.concatenate([target.ravel() for _, _, target in lmscore.pools([pd.DataFrame({"text": texts})], v)])
    assert sorted(got[got >= 0].tolist()) == want


# classifiers


def labelled(spark, n=300):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        toxic, good = int(i % 4 == 0), int(i % 3 > 0)
        words = prose(60, rng).split()
        if toxic:
            words[int(rng.integers(60))] = "vileword"
        text = " ".join(words)
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, good, toxic, 1))
    return rows, spark.createDataFrame(labels + [(0, None, None, 1), (None, 1, 1, 1), (9999, 0, 1, 1)], "doc_id long, quality int, toxic int, text int"), labels


def test_toxicity(spark):
    rows, labels, truth = labelled(spark)
    edge = [(i + 5000 if i is not None else None, *x) for i, *x in EDGE]
    got = toxicity.score_toxicity(table(spark, rows + edge), labels).collect()
    assert len(got) == len(rows) + len(edge) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, t) for i, _, t, _ in truth if by[i].held_out]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in truth)
    assert np.mean([p == t for p, t in held]) > 0.95
    assert toxicity.score_toxicity(table(spark, []), labels).count() == 0
    none = toxicity.score_toxicity(table(spark, rows[:20]), labels.where("false")).collect()
    assert len({r.score for r in none}) == 1


def test_kneser_ney_sums_to_one(spark):
    rows, labels, _ = labelled(spark, 120)
    sample = table(spark, rows).join(labels.select("doc_id", F.col("toxic").alias("label")).where("label is not null"), "doc_id").select("text", "label")
    model = toxicity.fit(sample)
    known = len(model.ids) - ("" in model.ids)
    kinds = sample.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0))).alias("w")).distinct().count()
    words = [i for w, i in model.ids.items() if w]
    unseen = kinds + 1 - known  # words that share id 0, and the unknown word
    for c in (0, 1):
        assert model.unigram[c][words].sum() + unseen * model.unigram[c][0] == pytest.approx(1, abs=1e-6)


def test_kneser_ney_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "RARE", 2)
    monkeypatch.setattr(toxicity, "PAIR_RARE", 3)
    rng = np.random.default_rng(6)
    kinds = prose(25, rng).split()
    texts = [(" ".join(rng.choice(kinds, 12)), int(k % 3 == 0)) for k in range(60)] + [("vile thing vile", 1), ("", 0)]
    model = toxicity.fit(spark.createDataFrame(texts, "text string, label int"))
    tri = {(c, *t) for x, c in texts for w in [["", *x.split()]] for t in zip(["", *w], w, w[1:])}
    pair = {c: Counter((h, w) for k, _, h, w in tri if k == c) for c in (0, 1)}
    word = {c: Counter(w for _, w in pair[c]) for c in (0, 1)}
    vocabulary = set(word[0]) | set(word[1])
    size = {c: sum(word[c].values()) for c in (0, 1)}

    def discount(counts):
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        return ones / max(1, ones + 2 * twos)

    listed = {w for w in vocabulary if word[0][w] + word[1][w] > 2}
    linked = {p for p in set(pair[0]) | set(pair[1]) if pair[0][p] + pair[1][p] > 3}
    shared = lambda w: (min(word[c][w] / size[c] for c in (0, 1)) * sum(size.values()) / 2 if w in listed else 0) + 1
    shared_sum = sum(map(shared, vocabulary)) + 1

    def unigram(c, w):
        own = {x: max(0, word[c][x] - discount(word[c])) for x in listed}
        whole = size[c] + len(vocabulary) + 1
        return (own.get(w, 0) + (whole - sum(own.values())) * (shared(w) if w in vocabulary else 1) / shared_sum) / whole

    def bigram(c, h, w):
        kept = {p: max(0, n - discount(pair[c])) for p, n in pair[c].items() if p in linked and p[0] == h}
        if not any(p[0] == h for p in linked):
            return unigram(c, w)
        whole = sum(n for p, n in pair[c].items() if p[0] == h) + 100
        return (kept.get((h, w), 0) + (whole - sum(kept.values())) * unigram(c, w)) / whole

    for text in ("vile thing vile", texts[0][0], f"{kinds[0]} unheard {kinds[1]}"):
        words = text.split()
        want = [[bigram(c, h, w) for h, w in zip(["", *words], words)] for c in (0, 1)]
        assert model.probabilities([text])[0] == pytest.approx(np.array(want), rel=1e-9)
        ratio = sum(np.log(0.98 + 0.02 * t / o) for o, t in zip(*want)) / (len(words) + 20)
        assert model.ratios([text])[0] == pytest.approx(ratio)
    assert model.ratios(["", "..."]).tolist() == [0, 0]
    for h in ("", kinds[0], "unheard"):
        assert sum(bigram(1, h, w) for w in vocabulary | {"unheard"}) == pytest.approx(1)


def test_copies_do_not_make_a_word_toxic(spark):
    rng = np.random.default_rng(7)
    rows, labels, _ = labelled(spark, 400)
    copied = prose(40, rng)
    rows += [(1000 + i, f"{copied} vileword copy{i}") for i in range(150)] + [(2000 + i, f"{prose(20, rng)} {copied[:60]}") for i in range(20)]
    labels = labels.unionByName(spark.createDataFrame([(1000 + i, 1, 1, 1) for i in range(150)], labels.schema))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(table(spark, rows), labels).collect()}
    assert sum(got[2000 + i] for i in range(20)) <= 2


def test_repeated_ids_do_not_widen_the_sample(spark):
    rows, labels, _ = labelled(spark, 50)
    sample = toxicity.labelled_sample(table(spark, rows + [(1, f"other {i}") for i in range(500)]), labels, "toxic", 40)
    assert sample.count() == sample.select("doc_id").distinct().count()


def test_quality(spark):
    rows, labels, truth = labelled(spark)
    edge = [(i + 5000 if i is not None else None, *x) for i, *x in EDGE]
    got = quality.score_quality(table(spark, rows + edge), labels).collect()
    assert len(got) == len(rows) + len(edge) and all(r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].predicted == q for i, q, _, _ in truth if by[i].held_out]) > 0.95
    assert quality.score_quality(table(spark, []), labels).count() == 0


def test_forest_traversal_matches_row_by_row():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(400, 5))
    y = ((X[:, 0] > 0) ^ (X[:, 3] > 0.5)).astype(float)
    forest = quality.grow(X, y, trees=20)
    assert np.mean((forest.score(X) > 0.5) == y) > 0.97
    for x, s in zip(X[:30], forest.score(X[:30])):
        total = forest.prior
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[f[node]] > c[node])
            total += leaf[node - len(f)]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))


# pipeline


def test_pipeline_stages(spark, tmp_path):
    rows, labels, truth = labelled(spark, 200)
    item = prose(30)
    extra = [(1000, rows[1][1]), (1001, f"{prose(20)} {item}"), (1002, prose(100), None), (1003, None), (1004, "")]
    d = str(tmp_path)
    table(spark, rows + extra).select(*corpus_pipeline.COLUMNS).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = corpus_pipeline.materialise(stages["toxicity"](spark, docs, d))
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == list(corpus_pipeline.COLUMNS) and {1000, 1001, 1002, 1003, 1004} <= kept
    assert np.mean([(i in kept) == (t == 0) for i, _, t, _ in truth]) > 0.95
    single = corpus_pipeline.materialise(stages["jaccard_join"](spark, clean, d))
    assert {r.doc_id for r in single.collect()} == kept - {1000} and single.count() == len(kept) - 1
    pure = corpus_pipeline.materialise(stages["decontamination"](spark, single, d))
    assert {r.doc_id for r in pure.collect()} == kept - {1000, 1001}
    mixed = corpus_pipeline.materialise(stages["mixing"](spark, pure, d))
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix_documents(pure).collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert all(times[i] == (1 if s == 0 else max(1, int(t / s + 0.5)) if t else 0) for i, (t, s) in taken.items())
    sharded = stages["sharding"](spark, mixed, d)
    assert sharded.count() == mixed.count() == corpus_pipeline.run(spark, d).count()


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    """Half the rows have no id; ids repeat with different texts; one row is repeated whole; texts are null, empty or long."""
    rows, labels, _ = labelled(spark, 60)
    item, copied = prose(30), prose(50)
    rows = [(i if i % 2 else None, t) for i, t in rows]
    extra = [(1, prose(40)), (1, f"{prose(20)} {item}"), (None, f"{item} {prose(20)}"), (None, copied), (None, copied), (2000, copied), (3000, prose(9)), (3000, prose(9)), (7, None), (7, ""), (7, ""), (None, "long " * 30000, None)]
    extra += [extra[6]]
    d = str(tmp_path)
    docs = table(spark, rows + extra).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    listed = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = corpus_pipeline.materialise(stages["jaccard_join"](spark, docs, d))
    want = set(listed(docs)) - {(None, copied)}  # the copy with an id stays; every other text is of its own kind
    assert listed(one) == Counter(want)
    pure = corpus_pipeline.materialise(stages["decontamination"](spark, one, d))
    assert set(listed(pure)) == {(i, t) for i, t in want if item not in (t or "")}
    mixed = listed(stages["mixing"](spark, pure, d))
    assert set(mixed) <= set(listed(pure)) and {(7, None), (7, "")} <= set(mixed) and max(mixed.values()) <= 3
    assert any(i is None for i, _ in mixed) and corpus_pipeline.run(spark, d).count() > 0
    empty = docs.where("false")
    assert all(stage(spark, empty, d).count() == 0 for _, stage in corpus_pipeline.STAGES)
