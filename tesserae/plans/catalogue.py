"""Registered queries of the engine's own operators, and the same as DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.prefix import prefix_sum
from tesserae.operators import audit, bpe, dedup, fim, gates, housekeeping, numeric, packing
from tesserae.plans import oracles
from tesserae.plans.corpus import build_corpus
from tesserae.sources import records
from tesserae.storage import scratch_dir
from tesserae.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES = oracles.SQL

#: The shapes of three decoders (name, vocabulary, hidden, layers, heads, key and value heads, inner, tied).
MODELS = (
    ("250M", 32000, 1024, 16, 16, 4, 2816, False),
    ("500M", 32000, 1280, 26, 16, 4, 3584, False),
    ("1B", 32000, 1536, 38, 16, 4, 4096, False),
)
#: The configured sources and weights.
MIX_NAMES = ["starcoder-python", "codeparrot-clean", "fineweb-edu", "tiny-textbooks", "evol-codealpaca", "glaive-function-calling", "commitpackft-python"]
MIX_WEIGHTS = [0.53, 0.21, 0.10, 0.075, 0.05, 0.025, 0.01]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Text gate, exact dedup and the audit by source."""
    gated = docs_of(spark, d).where(gates.passes_text_gate(F.col("text")))
    keyed = gated.withColumn("digest", F.md5(F.array_join(T.py_split(F.col("text")), " ").cast("binary")))
    kept = dedup.first_of_each(keyed, "digest", "doc_id")
    return audit.corpus_audit(kept, F.size(T.py_split(F.col("text"))).cast("long"))


@query
def flagship_audit(spark, d):
    return flagship(spark, d)


@query
def text_stats(spark, d):
    t = F.col("text")
    return docs_of(spark, d).select(
        "doc_id", F.length(t).cast("long").alias("chars"), F.size(T.py_split(t)).cast("long").alias("words"),
        F.size(T.py_splitlines(t)).cast("long").alias("lines"), T.alnum_count(t).alias("alnum"),
    )


@query
def quality_gate(spark, d):
    return docs_of(spark, d).where(gates.passes_text_gate(F.col("text"))).select("doc_id")


@query
def quality_attrition(spark, d):
    return gates.attrition(docs_of(spark, d), gates.passes_text_gate(F.col("text")))


@query
def bracket_balance(spark, d):
    return docs_of(spark, d).select("doc_id", gates.brackets_balanced(F.col("text")).alias("balanced"))


@query
def ast_valid(spark, d):
    return docs_of(spark, d).select("doc_id", gates.python_parses("text").alias("valid"))


@query
def code_route(spark, d):
    """Sources 1, 11, ... stand in for pure code."""
    rows = docs_of(spark, d).withColumn("source", F.when(F.col("source").endswith("1"), F.concat(F.lit("python-"), "source")).otherwise(F.col("source")))
    return rows.groupBy("source").agg(F.bool_or(gates.is_pure_code(F.col("source"))).alias("pure_code"), F.count("*").alias("n"))


@query
def dedup_signatures(spark, d):
    return dedup.signatures(docs_of(spark, d)).select("doc_id", "exact", F.array_join("bands", ",").alias("bands"))


@query
def dedup_exact(spark, d):
    keyed = docs_of(spark, d).select("doc_id", F.md5(F.array_join(T.py_split(F.col("text")), " ").cast("binary")).alias("exact"))
    return keyed.groupBy("exact").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query
def dedup_near(spark, d):
    return dedup.near_dedup(docs_of(spark, d))


@query
def dedup_attrition(spark, d):
    docs = docs_of(spark, d)
    kept = dedup.near_dedup(docs).withColumn("k", F.lit(True))
    return gates.attrition(docs.select("doc_id", "source").join(kept, "doc_id", "left"), F.col("k"))


@query
def source_budget(spark, d):
    return records.source_budgets(spark, MIX_NAMES, MIX_WEIGHTS)


@query
def source_registry(spark, d):
    return records.registry_lookup(spark.createDataFrame([(n,) for n in MIX_NAMES], "name string"))


@query
def budgeted_prefix(spark, d):
    docs = docs_of(spark, d)
    budgets = docs.groupBy("source").agg(F.expr("sum(length(text)) div 2").alias("budget_chars"))
    return records.budgeted_prefix(docs, budgets).select("doc_id", "source", "chars_before")


@query
def acquired_volume(spark, d):
    return audit.acquired_volume(docs_of(spark, d))


def turns(spark, d) -> DataFrame:
    """First and second turn of each conversation."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    nth = lambda k: F.min_by("text", "turn") if k == 0 else F.element_at(F.sort_array(F.collect_list(F.when(F.col("turn") == 1, F.struct("turn", "text")))), 1)["text"]
    return c.where("turn < 2").groupBy("conv_id").agg(nth(0).alias("a"), nth(1).alias("b"))


@query
def format_chat(spark, d):
    """The first turn, and all later ones in turn order as the chat."""
    c = spark.read.parquet(f"{d}/conversations.parquet").withColumn("text", F.coalesce("text", F.lit("None")))
    told = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"].alias("t"))
    later = F.when(F.size("t") > 1, F.array_join(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1))), "\n\n"))
    return told.select("conv_id", records.format_chat(F.get("t", F.lit(0)), later).alias("text"))


@query
def format_instruction(spark, d):
    return turns(spark, d).select("conv_id", records.format_instruction(F.col("a"), F.col("b")).alias("text"))


@query
def format_diff(spark, d):
    empty = F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.col("a"))
    return turns(spark, d).select("conv_id", records.format_diff(empty, F.col("a"), F.col("b"), F.lit(None).cast("string")).alias("text"))


@query
def format_problem(spark, d):
    solutions = F.when(F.col("conv_id") % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("b", "a"))
    return turns(spark, d).select("conv_id", records.format_problem(F.col("a"), solutions).alias("text"))


@query
def format_content(spark, d):
    none = F.lit(None).cast("string")
    return turns(spark, d).select("conv_id", records.format_content(none, F.lit(""), F.col("b")).alias("text"))


@query
def infill_prompt(spark, d):
    return turns(spark, d).where("b is not null").select("conv_id", records.infill_prompt(F.col("a"), F.col("b")).alias("text"))


@query
def eval_text(spark, d):
    text = F.concat("a", F.lit("\n"), "b")
    return turns(spark, d).where(F.length(text) > 20).select("conv_id", text.alias("text"))


@query
def decode_records(spark, d):
    lines = docs_of(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("[1, 2] \\n "), F.col("lang"))).otherwise(F.lit('{"x": 1}')).alias("value"))
    return records.decode_lines(lines).select("doc_id", "text")


@query
def jsonl_round_trip(spark, d):
    path = f"{scratch_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    records.write_jsonl(docs_of(spark, d), path)
    back = records.decode_lines(spark.read.text(path)).groupBy("source")
    return back.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query
def fim_transform(spark, d):
    return docs_of(spark, d).select("doc_id", fim.fim_transform(F.col("doc_id"), F.col("text")).alias("text"))


@query
def pretoken_counts(spark, d):
    return bpe.pretoken_counts(docs_of(spark, d))


@query
def letter_run_counts(spark, d):
    return docs_of(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r" ?\p{L}+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def bpe_merges(spark, d):
    merges = bpe.learn_merges(bpe.pretoken_counts(docs_of(spark, d)))
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank long, left long, right long")


@query
def bpe_pack(spark, d):
    docs = docs_of(spark, d)
    merges = bpe.learn_merges(bpe.pretoken_counts(docs))
    return packing.pack(bpe.encode(docs.select("doc_id", "text"), merges), 2048).select("chunk", packing.shard_number(F.col("chunk")).alias("shard"), F.md5(F.array_join("tokens", ",").cast("binary")).alias("digest"))


def worded(spark, d) -> DataFrame:
    return docs_of(spark, d).select("doc_id", packing.word_ids(F.col("text")).alias("ids"))


@query
def pack_sequences(spark, d):
    packed = packing.pack(worded(spark, d), 256)
    return packed.select("chunk", packing.shard_number(F.col("chunk"), 100).alias("shard"), F.md5(F.array_join("tokens", ",").cast("binary")).alias("digest"))


@query
def pack_overlapping(spark, d):
    packed = packing.pack(worded(spark, d), 256, overlap=1)
    x, y = packing.training_pair(F.col("tokens"), 256)
    digest = lambda c: F.md5(F.array_join(c, ",").cast("binary"))
    return packed.select("chunk", digest(x).alias("x"), digest(y).alias("y"))


@query
def next_token_pairs(spark, d):
    packed = packing.pack(worded(spark, d), 256)
    pairs = packing.next_token_pairs(F.col("tokens"))
    return packed.select("chunk", F.size(pairs).cast("long").alias("n"), F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + F.abs(p["next"] - p["token"])).alias("moved"))


@query
def shard_round_trip(spark, d):
    path = f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    packed = packing.pack(worded(spark, d), 256)
    records.write_sharded(packed.withColumn("shard", packing.shard_number(F.col("chunk"), 100)), path)
    return records.read_sharded(spark, path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("sequences"))


@query
def corpus_audit(spark, d):
    return audit.corpus_audit(docs_of(spark, d), F.size(T.py_split(F.col("text"))).cast("long"))


@query
def epoch_arithmetic(spark, d):
    rows = audit.corpus_audit(docs_of(spark, d), F.size(T.py_split(F.col("text"))).cast("long"))
    return rows.select("source", F.round(audit.epochs(F.col("tokens"), 1000), 6).alias("epochs"))


def numbered_losses(spark, d) -> DataFrame:
    """Events stand in for a loss table: a dense index in id order and value / 100."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("value") / 100).alias("loss"), F.lit(1).cast("long").alias("one"))
    return prefix_sum(e, "one", "event_id", "index")


@query
def batch_losses(spark, d):
    return audit.batch_mean_loss(numbered_losses(spark, d), "index", "loss").select("batches", F.round("loss", 9).alias("loss"))


@query
def step_losses(spark, d):
    return audit.step_losses(numbered_losses(spark, d)).select("step", F.round("loss", 9).alias("loss"))


@query
def perplexity_gap(spark, d):
    rows = numbered_losses(spark, d)
    train = audit.batch_mean_loss(rows.where("index % 2 = 0").withColumn("index", F.expr("index div 2")), "index", "loss")
    held = audit.batch_mean_loss(rows.where("index % 2 = 1").withColumn("index", F.expr("index div 2")), "index", "loss")
    both = train.select(F.lit(1).alias("k"), F.col("loss").alias("t")).join(held.select(F.lit(1).alias("k"), F.col("loss").alias("v")), "k")
    return both.select(F.round(audit.perplexity(F.col("t")), 6).alias("train_ppl"), F.round(audit.perplexity(F.col("v"), True), 6).alias("val_ppl"), F.round(F.col("v") - F.col("t"), 9).alias("gap"))


@query
def held_out_rows(spark, d):
    return audit.held_out_rows(numbered_losses(spark, d), "index", 500).select("event_id", "index")


@query
def second_half(spark, d):
    return audit.second_half(docs_of(spark, d).select("doc_id", "source"), "doc_id", "source")


@query
def seeded_shuffle(spark, d):
    return docs_of(spark, d).select("doc_id", audit.seeded_order(F.col("doc_id"), 7).alias("place")).orderBy("place")


@query
def epoch_cycle(spark, d):
    return audit.epoch_positions(spark.range(1000).withColumnRenamed("id", "step"), "step", 1000)


@query
def lr_schedule(spark, d):
    steps = spark.range(5001).withColumnRenamed("id", "step")
    return steps.select("step", F.round(numeric.lr_schedule(F.col("step"), 500, 4482, 6e-4, 6e-5), 12).alias("lr"))


@query
def model_sizes(spark, d):
    rows = spark.createDataFrame(MODELS, "name string, v long, h long, l long, a long, k long, f long, tied boolean")
    n = numeric.parameter_count(*map(F.col, ("v", "h", "l", "a", "k", "f", "tied")))
    return rows.select(
        "name", n.alias("parameters"), numeric.flops_per_step(n, F.lit(256), F.lit(2048)).alias("flops"),
        F.round(numeric.residual_scale(F.col("l")), 9).alias("scale"), F.lit(256 * 2048).cast("long").alias("tokens_per_step"), F.lit(256 * 2048 * 4482).cast("long").alias("total_tokens"),
    )


@query
def run_costs(spark, d):
    rows = spark.createDataFrame([("T4", 0.55, 6685.0), ("L40S", 2.89, 151e6 / 3600), ("PRO 6000", 4.64, 300e6 / 3600), ("PRO 6000 spot", 2.05, 300e6 / 3600)], "device string, rate double, tokens_per_s double")
    hours = F.lit(256.0 * 2048 * 4482) / F.col("tokens_per_s") / 3600
    return rows.select("device", F.round(hours, 6).alias("hours"), F.round(numeric.run_cost(hours, F.col("rate")), 6).alias("cost"), F.round(audit.throughput(F.col("tokens_per_s") * 0.5, F.lit(0.5)), 6).alias("throughput"))


@query
def rope_angles(spark, d):
    return numeric.rope_table(spark, 64, 128).select("position", "i", F.round("cos", 9).alias("cos"), F.round("sin", 9).alias("sin"))



@query
def rms_norm(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(numeric.total(F.transform(numeric.rms_norm(F.col("embedding")), lambda x: x * x)), 6).alias("power"), F.round(F.get(numeric.rms_norm(F.col("embedding")), 3), 6).alias("fourth"))


@query
def softmax_tokens(spark, d):
    p = numeric.softmax(F.col("embedding"), 0.2)
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        "vec_id", F.round(F.array_max(p), 6).alias("top"), numeric.greedy_token(F.col("embedding")).cast("long").alias("token"), F.round(numeric.cross_entropy(F.col("embedding"), F.lit(5)), 6).alias("loss"))


def checkpoints(spark) -> DataFrame:
    names = [(f"checkpoint_step_{s}.pt", 2_800_000_000 + s) for s in range(50_000, 75_001, 1000)]
    return spark.createDataFrame([*names, ("latest_checkpoint.pt", 5), ("checkpoint_step_x.pt", 6), ("notes.txt", 7), ("checkpoint_chunk1.pt", 8)], "name string, size long")


@query
def retention_plan(spark, d):
    return housekeeping.retention_plan(checkpoints(spark))


@query
def retention_totals(spark, d):
    return housekeeping.retention_totals(housekeeping.retention_plan(checkpoints(spark))).select("deleted", F.round("freed_gib", 6).alias("freed_gib"))


@query
def save_cadence(spark, d):
    return housekeeping.cadence(spark.range(1, 4483).withColumnRenamed("id", "step"), 1, 4482, 100)


@query
def save_triggers(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", housekeeping.saves_at(F.col("event_id"), 100, F.col("value"), 200.0).alias("saves"))


def planted(spark, d) -> DataFrame:
    """Documents with a credential in every seventh and a dummy in every eleventh, made of parts."""
    token = F.concat(F.lit(" hf" + "_"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(" "))
    dummy = F.lit(" hf" + "_" + "x" * 32 + " ")
    return docs_of(spark, d).select("doc_id", F.concat("text", F.when(F.col("doc_id") % 7 == 0, F.concat(token, F.lit("again"), token)).otherwise(""), F.when(F.col("doc_id") % 11 == 0, dummy).otherwise("")).alias("text"))


@query
def credential_scan(spark, d):
    return housekeeping.scan_credentials(planted(spark, d))


@query
def credential_redact(spark, d):
    return planted(spark, d).select("doc_id", housekeeping.redact(F.col("text")).alias("text"))


def graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers as nodes with a row per order key, suppliers of the same nation as edge ends that may be missing."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    nodes = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("label"))
    edges = orders.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"))
    return nodes, edges


@query
def graph_upsert(spark, d):
    return housekeeping.upsert_nodes(graph(spark, d)[0], "version")


@query
def graph_orphans(spark, d):
    nodes, edges = graph(spark, d)
    return housekeeping.orphan_edges(edges, nodes)


@query
def stream_exact_dedup(spark, d):
    reader = spark.readStream.schema(docs_of(spark, d).schema)
    files = reader.parquet(f"{d}/documents.parquet") if _is_folder(spark, d) else reader.option("pathGlobFilter", "documents.parquet").parquet(d)
    stream = jobs.stream_exact_dedup(files)
    run = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    return jobs.run_available(spark, stream.select("digest"), f"dedup_{uuid.uuid4().hex}", f"{run}/out", f"{run}/state")


def _is_folder(spark: SparkSession, d: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query
def stream_step_windows(spark, d):
    """The log's windows as a batch; the same plan runs on a stream."""
    return jobs.stream_step_log(spark.read.parquet(f"{d}/events.parquet"), "ts", "event_id", "value", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "steps", F.round("loss", 6).alias("loss"))


@query
def corpus_build(spark, d):
    """Quality, dedup, byte pairs, fill-in-the-middle, encoding and packing end to end, as counts by shard."""
    packed = build_corpus(docs_of(spark, d), vocabulary=32_000)
    return packed.groupBy(packing.shard_number(F.col("chunk"), 100).alias("shard")).agg(F.count("*").alias("sequences"), F.sum(F.size("tokens").cast("long")).alias("tokens"))
