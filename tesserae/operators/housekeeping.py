"""Checkpoint retention, save and log cadences, secret scan and redaction, and the property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import let
from tesserae.operators.dedup import latest_of_each

#: Files and steps that are always kept, and the step from which all are.
SPECIAL_FILES = ("latest_checkpoint.pt", "checkpoint_chunk1.pt")
MILESTONES, KEEP_FROM = (55_000, 61_000, 67_000, 73_000), 67_000
#: Patterns of credentials in the order in which they are applied, and what marks a dummy.
CREDENTIALS = (
    ("HuggingFace Token", r"hf_[a-zA-Z0-9]{30,}"),
    ("GitHub PAT (Classic)", r"ghp_[a-zA-Z0-9]{35,}"),
    ("GitHub PAT (Fine-grained)", r"github_pat_[a-zA-Z0-9_]{50,}"),
    ("OpenAI Key", r"sk-[a-zA-Z0-9]{30,}"),
    ("AWS Key", r"AKIA[0-9A-Z]{16}"),
)
DUMMY = "xxxx|example|your_"
REDACTED = 'os.environ.get("HF_TOKEN", "<REDACTED_SECRET>")'


def retention_plan(files: DataFrame) -> DataFrame:
    """(name, size, step, action): ``keep``, ``delete``, ``skip`` (no step in the name) or ``ignore`` (not a checkpoint)."""
    named = files.withColumn("step", F.expr(r"try_cast(regexp_extract(name, '^checkpoint_step_(.*)\\.pt$', 1) AS BIGINT)"))
    is_step = F.col("name").startswith("checkpoint_step_") & F.col("name").endswith(".pt")
    action = (
        F.when(F.col("name").isin(*SPECIAL_FILES), "keep").when(~is_step, "ignore").when(F.col("step").isNull(), "skip")
        .when(F.col("step").isin(*MILESTONES) | (F.col("step") >= KEEP_FROM), "keep").otherwise("delete")
    )
    return named.select("name", "size", "step", action.alias("action"))


def retention_totals(plan: DataFrame) -> DataFrame:
    """(deleted, freed_gib) of a plan."""
    gone = F.col("action") == "delete"
    return plan.agg(F.count_if(gone).alias("deleted"), (F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)) / F.lit(1024.0**3)).alias("freed_gib"))


def saves_at(step: Column, every: int, elapsed: Column, limit: float) -> Column:
    """A save is due at multiples of ``every`` after step 0, or once the time since the last one reaches the limit."""
    return ((step > 0) & (step % every == 0)) | (elapsed >= limit)


def cadence(steps: DataFrame, first: int, last: int, save_every: int, log_every: int = 5, upload_every: int = 1000) -> DataFrame:
    """(step, logs, saves, uploads): uploads only happen with a save."""
    step = F.col("step")
    saves = (step % save_every == 0) | (step == last)
    return steps.select("step", ((step % log_every == 0) | (step == first)).alias("logs"), saves.alias("saves"), (saves & (step % upload_every == 0)).alias("uploads"))


def real_matches(text: Column, pattern: str) -> Column:
    """Distinct matches that are no dummies."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda m: ~F.lower(m).rlike(DUMMY))


def redact(text: Column) -> Column:
    """Pattern after pattern, each distinct match that is no dummy replaced wherever it stands."""
    def clean(pattern: str):
        replaced = lambda t: F.aggregate(real_matches(t, pattern), t, lambda s, m: F.replace(s, m, F.lit(REDACTED)))
        return lambda t: F.when(~t.rlike(pattern), t).otherwise(replaced(t))

    for _, pattern in CREDENTIALS:
        text = let(text, clean(pattern))
    return text


def scan_credentials(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, leaks, masked): distinct credentials in each text, and them with all but the ends hidden."""
    found = F.flatten(F.array(*(real_matches(F.col("text"), p) for _, p in CREDENTIALS)))
    masked = F.transform(found, lambda m: F.concat(F.left(m, F.lit(6)), F.lit("..."), F.right(m, F.lit(4))))
    return docs.select(F.col(id_col).alias("doc_id"), F.size(found).cast("long").alias("leaks"), F.array_join(masked, ",").alias("masked"))


def upsert_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row per id, the latest."""
    return latest_of_each(nodes, "id", order)


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(endpoint) of edges without a node."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").withColumnRenamed("id", "endpoint")
