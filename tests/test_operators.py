"""Micro-cases with hand-derived results, and properties."""

import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.prefix import prefix_sum
from tesserae.functions.text import alnum_count, py_split, py_splitlines, py_strip
from tesserae.operators import audit, bpe, dedup, fim, gates, housekeeping, numeric, packing
from tesserae.plans import catalogue
from tesserae.plans.corpus import build_corpus
from tesserae.sources import records


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, source) for i, t in enumerate(texts)], "doc_id long, text string, source string")


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


TEXTS = ["", " ", "a", "a b", " a\tb\n", "a\r\nb\rc\n", "a b\x1cc\n\n", "é漢²½ _-", " x　", "\n", "a\x0bb\x0cc\x85d"]


def test_python_string_semantics(spark):
    assert column(spark, TEXTS, py_split) == [t.split() for t in TEXTS]
    assert column(spark, TEXTS, py_splitlines) == [t.splitlines() for t in TEXTS]
    assert column(spark, TEXTS, py_strip) == [t.strip() for t in TEXTS]
    assert column(spark, TEXTS, alnum_count) == [sum(c.isalnum() for c in t) for t in TEXTS]


def test_decode_lines(spark):
    lines = ['{"text":"a\\nb"}', '{"x":1}', "[1,2]", "not json\\nx", "  ", '{"text":null}', "{'text':'a'}"]
    got = [r.text for r in records.decode_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == ["a\nb", "", "[1,2]", "not json\nx", None, "", "{'text':'a'}"]


def test_text_gate(spark):
    cases = {"x" * 40: False, "a\n" + "b" * 27: False, "a\n" + "b" * 28: True, "a" * 40 + "\n": False, "aaaaaaaa\n" + "-" * 23: True, "aaaaaaa\n" + "-" * 24: False, "a " + "b" * 30: True}
    assert column(spark, list(cases), gates.passes_text_gate) == list(cases.values())


def test_brackets(spark):
    cases = {"": True, "([{}])": True, "([)]": False, ")(": False, "(": False, 'print(")")': False, "a}": False, "x(1)[2]{3}": True}
    assert column(spark, list(cases), gates.brackets_balanced) == list(cases.values())


def test_python_parses(spark):
    assert column(spark, ["x = 1", "def f(:", "a\0b", "<|fim_prefix|>x"], gates.python_parses) == [True, False, False, False]


@pytest.mark.parametrize(
    "texts, kept",
    [
        (["a b c", "a  b\nc"], [0]),
        (["a b c d e", "f g h i j"], [0]),
        (["a b c d e f g", "a b c X e f g"], [0, 1]),
        (["a b c d e f g", "a b c d e f X"], [0]),
        (["a b c d e f g", "p a b c d e f g q"], [0]),
        (["a b c d e f g", "X b c d e f Y", "p X b c d e f Y q"], [0, 2]),
        ([], []),
        (["", None, "x"], [0, 2]),
    ],
)
def test_greedy_dedup(spark, texts, kept):
    assert sorted(r.doc_id for r in dedup.near_dedup(docs(spark, texts)).collect()) == kept


def test_dedup_is_idempotent(spark):
    rows = docs(spark, [f"w{i % 7} a b c d e f{i % 3}" for i in range(60)])
    once = dedup.near_dedup(rows)
    assert sorted(once.collect()) == sorted(dedup.near_dedup(rows.join(once, "doc_id", "left_semi")).collect())


def test_budgets(spark):
    def kept(lengths, budget):
        budgets = spark.createDataFrame([("a", budget)], "source string, budget_chars long")
        return sorted(r.doc_id + 1 for r in records.budgeted_prefix(docs(spark, ["x" * n for n in lengths]), budgets).collect())

    assert kept([30, 10, 50, 40], 60) == [1, 3]
    assert kept([30, 40], 0) == [1]
    assert kept([10, 40], 0) == []
    budgets = records.source_budgets(spark, ["a", "b", "a", "z"], [0.5, 0.25, 0.125], 100)
    assert dict(map(tuple, budgets.collect())) == {"a": 50, "b": 100}


def test_formatters(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    s = lambda x: F.lit(x).cast("string")
    assert pick(records.format_diff(s(""), s("b"), s(None), s("f"))) == "<|fim_prefix|>b<|fim_middle|>f"
    assert pick(records.format_problem(s("d"), F.expr("cast(array() as array<string>)"))).endswith("[]")
    assert pick(records.format_chat(s(" a"), s("b "))) == "a\n\nb"
    assert pick(records.format_instruction(s("i"), s(None))) == "### Instruction:\ni\n\n### Response:\nNone"
    assert pick(records.format_content(s(None), s(""), s(" t "))) == " t "
    assert pick(records.infill_prompt(s("p"), s("q"))) == "<|fim_prefix|>p<|fim_suffix|>q<|fim_middle|>"


def test_chat_has_every_turn(spark, tmp_path):
    rows = [(1, t, f"t{t}") for t in (3, 0, 2, 11, 1)] + [(2, 0, "alone"), (3, 0, "a"), (3, 1, "b ")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.text for r in catalogue.QUERIES["format_chat"](spark, str(tmp_path)).collect()}
    assert got == {1: "t0\n\nt1\n\nt2\n\nt3\n\nt11", 2: "alone\n\nNone", 3: "a\n\nb"}


def test_shuffle_has_every_document(spark, tmp_path):
    docs(spark, ["x"] * 150).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["seeded_shuffle"](spark, str(tmp_path)).collect()
    places = {i: hashlib.md5(b"7:%d" % i).hexdigest() for i in range(150)}
    assert [tuple(r) for r in got] == sorted(places.items(), key=lambda x: x[1])


def test_registry(spark):
    names = spark.createDataFrame([("code-contests",), ("nobody",)], "name string")
    got = {r.name: r.format for r in records.registry_lookup(names).collect()}
    assert got == {"code-contests": "problem_solution", "nobody": "content"}
    with pytest.raises(Exception, match="unknown source"):
        records.registry_lookup(names, strict=True).collect()


def test_fim(spark):
    def run(texts, rate=1.0):
        return [r[0] for r in docs(spark, texts).orderBy("doc_id").select(fim.fim_transform(F.col("doc_id"), F.col("text"), rate)).collect()]

    short, two = "a\nb\nc" + "x" * 44, "x" * 30 + "\n" + "y" * 30
    assert run([short, two]) == [short, two]
    three = "\n".join(["p" * 20, "m" * 20, "s" * 20])
    assert run([three]) == ["<|fim_prefix|>" + "p" * 20 + "<|fim_suffix|>" + "s" * 20 + "<|fim_middle|>" + "m" * 20]
    long = ["\n".join(f"line {i} of {k} and more" for i in range(k + 3)) for k in range(20)]
    for text, cut in zip(long, run(long)):
        p, rest = cut.removeprefix("<|fim_prefix|>").split("<|fim_suffix|>")
        s, m = rest.split("<|fim_middle|>")
        assert p and m and s and "\n".join([p, m, s]) == text
    assert run(long, 0.0) == long


def test_packing(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3, 0]), (1, [4, 5, 6, 7, 0]), (5000, [8, 9, 0])], "doc_id long, ids array<long>")
    plain = {r.chunk: r.tokens for r in packing.pack(rows, 4).collect()}
    assert plain == {0: [1, 2, 3, 0], 1: [4, 5, 6, 7], 2: [0, 8, 9, 0]}
    over = {r.chunk: r.tokens for r in packing.pack(rows, 4, overlap=1).collect()}
    assert over == {0: [1, 2, 3, 0, 4], 1: [4, 5, 6, 7, 0]}
    assert [r[0] for r in spark.range(3).select(packing.shard_number(F.col("id"), 2)).collect()] == [1, 1, 2]
    assert packing.pack(rows.where("false"), 4).count() == 0


def test_prefix_sum_across_buckets_and_null_groups(spark):
    rows = spark.createDataFrame([(i, i % 5 + 1, None if i % 2 else "g") for i in range(300)], "id long, n long, g string")
    got = {r.id: r.s for r in prefix_sum(rows, "n", "id", "s", ("g",), width=7).collect()}
    assert got == {i: sum(j % 5 + 1 for j in range(i) if j % 2 == i % 2) for i in range(300)}


def test_bpe_round_trip(spark):
    texts = ["hello hello yellow", "l'été 漢字 \n\n x", "", "<|endoftext|>hello"]
    rows = docs(spark, texts)
    merges = bpe.learn_merges(bpe.pretoken_counts(rows), vocabulary=290)
    assert 0 < len(merges) <= 23
    ids = [r.ids for r in bpe.encode(rows, merges).orderBy("doc_id").collect()]
    assert all(x[-1] == bpe.EOS for x in ids)
    assert [bpe.decode(x[:-1], merges) for x in ids] == texts
    assert ids[3][0] == 0


def test_merges_of_all_types(spark):
    rng = random.Random(2)
    counts = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))): rng.randint(1, 4) for _ in range(300)} | {"aaaaaaa": 9, "éé": 2}
    words, want = {w: [len(bpe.SPECIALS) + b for b in w.encode()] for w in counts}, []
    while len(want) < 150:
        pairs = Counter()
        for w, ids in words.items():
            for pair in zip(ids, ids[1:]):
                pairs[pair] += counts[w]
        want.append(min(pairs, key=lambda p: (-pairs[p], p)))
        words = {w: bpe.merge(ids, want[-1], len(bpe.SPECIALS) + 255 + len(want)) for w, ids in words.items()}
    rows = spark.createDataFrame(list(counts.items()), "token string, n long")
    vocabulary = len(bpe.SPECIALS) + 256 + 150
    assert bpe.learn_merges(rows, vocabulary) == want
    assert bpe.learn_merges(rows, vocabulary, driver_types=0) == want


def test_merges_take_few_passes(spark, monkeypatch):
    rng, tables = random.Random(3), []
    made = {"".join(rng.choice("abcdefghij") for _ in range(rng.randint(6, 14))): rng.randint(1, 9) for _ in range(2000)}
    rows = spark.createDataFrame(list(made.items()), "token string, n long")
    monkeypatch.setattr(bpe, "materialise", lambda df, cut=bpe.materialise: tables.append(df) or cut(df))
    many = bpe.learn_merges(rows, 700, driver_types=1500)
    assert len(tables) < 40  # a table a pass over the executors, until the driver has room
    monkeypatch.setattr(bpe, "LAST_SHARE", 4000, raising=False)  # a guess of the last merge's count that is too high
    assert len(many) == 433 and bpe.learn_merges(rows, 700) == many


def test_types_encoded_together_as_alone():
    rng, base = random.Random(5), len(bpe.SPECIALS)
    made = [(base + ord("a"), base + ord("a"))]
    for new in range(base + 257, base + 300):
        made.append((rng.choice([base + ord(c) for c in "abc"] + list(range(base + 256, new))), rng.choice([base + ord(c) for c in "abc"])))
    made = list(dict.fromkeys(made))
    tokens, want = ["", "aaaaaaa", "é"] + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 20))) for _ in range(200)], []
    for t in tokens:
        ids = [base + b for b in t.encode()]
        while found := [made.index(p) for p in zip(ids, ids[1:]) if p in made]:
            ids = bpe.merge(ids, made[min(found)], base + 256 + min(found))
        want.append(ids)
    codes = np.array([a * bpe.WIDE + b for a, b in made])
    order = np.argsort(codes)
    assert bpe.type_ids(tokens, codes[order], order) == want and bpe.type_ids(["ab"], codes[:0], order[:0]) == [[base + 97, base + 98]]


def test_bpe_pair_table_finds_what_a_dict_does():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, (2, 4000)).astype(np.int32)
    codes = np.unique(a[:900].astype(np.int64) * bpe.WIDE + b[:900])
    ranks = rng.permutation(len(codes))
    known = dict(zip(codes.tolist(), ranks.tolist()))
    want = [known.get(x * bpe.WIDE + y, bpe.NEVER) for x, y in zip(a.tolist(), b.tolist())]
    assert bpe.PairTable(codes, ranks).find(a, b).tolist() == want
    assert (bpe.PairTable(codes[:0], ranks[:0]).find(a, b) == bpe.NEVER).all()


def test_bpe_texts_are_encoded_once_when_packed(spark):
    rows = spark.createDataFrame([(0, "a<|fim_prefix|>b <|c"), (1, None), (2, "")], "doc_id long, text string")
    encoded = bpe.encode(rows, []).where("ids is not null")
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("ids_of(") == 1
    base = len(bpe.SPECIALS)
    want = {0: [base + 97, 3, base + 98, base + 32, base + 60, base + 124, base + 99, 0], 1: [0], 2: [0]}
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert [r.ids for r in bpe.encode(rows, [], eos=None).orderBy("doc_id").collect()] == [x[:-1] for x in want.values()]


def test_no_type_is_left_out(spark):
    rows = spark.range(100_001).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("token"), F.lit(2).cast("long").alias("n"))
    rare = spark.createDataFrame([("zq", 1)], "token string, n long")
    q = len(bpe.SPECIALS) + ord("q")
    assert any(b == q for _, b in bpe.learn_merges(rows.where("id < 100000").unionByName(rare), 130_000))


def test_schedule_and_sizes(spark):
    steps = [0, 250, 500, 2491, 4482, 9000]
    got = column(spark, steps, lambda s: numeric.lr_schedule(s, 500, 4482, 6e-4, 6e-5), "long")
    assert got == pytest.approx([0, 3e-4, 6e-4, 3.3e-4, 6e-5, 6e-5])
    n = numeric.parameter_count(*map(F.lit, (32000, 1024, 16, 16, 4, 2816, False)))
    assert spark.range(1).select(n).first()[0] == 245_924_864


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 2.0],)], "v array<double>")
    p, r, k, e = rows.select(numeric.softmax(F.col("v")), numeric.rms_norm(F.col("v"), 0.0), numeric.greedy_token(F.col("v")), numeric.cross_entropy(F.col("v"), F.lit(0))).first()
    z = math.e + 2 * math.e**2
    assert p == pytest.approx([math.e / z, math.e**2 / z, math.e**2 / z]) and r == pytest.approx([x / math.sqrt(3) for x in (1, 2, 2)])
    assert k == 1 and e == pytest.approx(math.log(z) - 1)


def test_losses(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 32 else 4.0) for i in range(35)], "i long, x double")
    assert audit.batch_mean_loss(rows, "i", "x").first() == (3, 2.0)
    assert audit.batch_mean_loss(rows.where("false"), "i", "x").first() == (0, 0.0)
    five = spark.createDataFrame([(i, "s") for i in range(5)], "i long, g string")
    assert sorted(r.i for r in audit.second_half(five, "i", "g").collect()) == [2, 3, 4]


def test_retention(spark):
    names = ["checkpoint_step_55000.pt", "checkpoint_step_60000.pt", "checkpoint_step_67000.pt", "checkpoint_step_x.pt", "latest_checkpoint.pt", "notes.txt"]
    plan = housekeeping.retention_plan(spark.createDataFrame([(n, 1024**3) for n in names], "name string, size long"))
    assert {r.name: r.action for r in plan.collect()} == dict(zip(names, ["keep", "delete", "keep", "skip", "keep", "ignore"]))
    assert housekeeping.retention_totals(plan).first() == (1, 1.0)


def test_credentials(spark):
    key, token, dummy, short = "AKIA" + "A" * 16, "hf" + "_" + "a" * 30, "hf" + "_" + "x" * 30, "hf" + "_" + "a" * 29
    rows = docs(spark, [f"{key} {token} {key}", dummy, short, ""])
    assert [r.leaks for r in housekeeping.scan_credentials(rows).orderBy("doc_id").collect()] == [2, 0, 0, 0]
    clean = [r[0] for r in rows.orderBy("doc_id").select(housekeeping.redact(F.col("text"))).collect()]
    assert key not in clean[0] and token not in clean[0] and clean[0].count("REDACTED") == 3 and clean[1:] == [dummy, short, ""]


def test_graph(spark):
    nodes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, version long, label string")
    assert sorted((r.id, r.label) for r in housekeeping.upsert_nodes(nodes, "version").collect()) == [("a", "y"), ("b", "z")]
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    assert [r.endpoint for r in housekeeping.orphan_edges(edges, nodes).collect()] == ["c"]


def test_jsonl_reading(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "web_raw.jsonl").write_text(json.dumps({"text": "é\n1"}) + "\n\nplain\\nline\n", encoding="utf-8")
    got = records.read_jsonl(spark, str(tmp_path / "in"), "*_raw.jsonl")
    assert sorted(map(tuple, got.collect())) == [("plain\nline", "web"), ("é\n1", "web")]
    assert records.read_jsonl(spark, str(tmp_path / "none"), fallbacks=((str(tmp_path / "in"), "*_raw.jsonl"),)).count() == 2
    assert records.read_jsonl(spark, str(tmp_path / "none"), strict=False).count() == 0
    with pytest.raises(FileNotFoundError):
        records.read_jsonl(spark, str(tmp_path / "none"))
    names = records.list_files(spark, str(tmp_path), ("jsonl",), (".git",))
    assert [r.name for r in names.collect()] == ["web_raw.jsonl"]


def test_corpus_build_conserves_tokens(spark):
    rows = docs(spark, ["\n".join(f"word{i} and {k} more words here" for i in range(k + 4)) for k in range(30)])
    packed = build_corpus(rows, length=16)
    assert packed.count() > 0 and packed.where(F.size("tokens") != 16).count() == 0
