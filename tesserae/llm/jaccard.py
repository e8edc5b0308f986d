"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles.  In each run a set walks down a random tree: at a node with path p it samples
the tokens t whose hash under p falls below a bound, about ``FANOUT`` of them, and moves on to the children (p, t).  Sets
that share a node share all tokens on its path.  Nodes with few sets are compared there; larger ones are split further on
sampled tokens; the runs together reach the target recall.  Candidates become exact links in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, text_or_empty
from tesserae.llm.components import connected
from tesserae.storage import keep_ids, materialise, small_side, split_join

#: Words of a shingle and least similarity.
WORDS, SIMILAR = 5, 0.8
#: Tokens sampled at a node, levels of the first descent and of each further one, and further descents.
FANOUT, LEVELS, DEEPER, DESCENTS = 1.6, 3, 2, 3
#: Recall that the runs reach for the pairs that are hardest to find.
TARGET = 0.98


def runs_for(target: float) -> int:
    """Runs that find a pair at the least similarity with probability ``target`` or more, in the worst case.

    That is a set and one that it contains, which sample ``FANOUT * SIMILAR`` common tokens a node, in nodes so crowded that
    they are split in every descent.  A run finds the pair if that branching process lives through all levels.
    """
    alive = 1.0
    for _ in range(LEVELS + DEEPER * DESCENTS):
        alive = 1 - math.exp(-FANOUT * SIMILAR * alive)
    return math.ceil(math.log(1 - target) / math.log(1 - alive))


RUNS = runs_for(TARGET)
#: Sets that a tree node may hold to be compared there.
BUCKET = 64
#: Sketch shares from which a set is linked to a head of its tree node, and from which it leaves the tree there.  A set
#: close to a head, at 0.55 or more, and one similar to it, at 0.8, leave the latter at 0.35 or more from the head.
NEAR, CLOSE = 0.2, 0.7
#: A tree node that holds more than this part of all paths is hot.
HOT_SHARE = 4000
#: Bins of the sketch that compares sets of a bucket; rows and tokens of a block in the exact comparison.
BINS, BLOCK_ROWS, BLOCK_TOKENS = 64, 2048, 2_000_000

#: Rows whose sets are held together by a worker.
SLICE = 512

PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * PRIME
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def token_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes from the word hashes of a text; a shorter text is one shingle, an empty one none."""
    w = np.asarray(words, dtype=np.int64).view(np.uint64)
    if not len(w):
        return w
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = mixed(h * PRIME + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def set_digest(tokens: np.ndarray) -> int:
    """The signed 64-bit digest that names a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(tokens.tobytes()), dtype=np.uint64).view(np.int64))


def descend(tokens: np.ndarray, paths: np.ndarray, levels: int) -> np.ndarray:
    """The paths that lead ``levels`` further down from ``paths``."""
    bound = np.uint64(min(2.0**64 - 2048, FANOUT / max(1, len(tokens)) * 2.0**64))
    for _ in range(levels):
        if not len(paths):
            break
        near, at = np.nonzero(tokens[None, :] * (mixed(paths) | np.uint64(1))[:, None] < bound) if len(tokens) * len(paths) < 4_000_000 else wide(tokens, paths, bound)
        paths = mixed(paths[near] * PRIME + tokens[at])
    return np.unique(paths)


def wide(tokens: np.ndarray, paths: np.ndarray, bound: np.uint64):
    """As one comparison path by path, for long texts."""
    found = [np.flatnonzero(tokens * (mixed(paths[i : i + 1]) | np.uint64(1)) < bound) for i in range(len(paths))]
    return np.repeat(np.arange(len(paths)), [len(x) for x in found]), np.concatenate(found)


ROOTS = mixed(np.arange(1, RUNS + 1, dtype=np.uint64))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The smallest token of each of ``BINS`` equal ranges of hash values, as 32 bits that are 0 for an empty range."""
    out = np.zeros(BINS, dtype=np.uint32)
    bins = (tokens >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = ((tokens[first] >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    return out.view(np.int32)


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, size, paths, sketch) of every row with an id; ``node`` names the set and is null for an empty one."""
    def build(batches):
        for batch in (whole.iloc[i : i + SLICE] for whole in batches for i in range(0, len(whole), SLICE)):
            sets = [token_set(w) for w in batch["words"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "node": pd.array([set_digest(t) if len(t) else None for t in sets], dtype="Int64"), "size": [len(t) for t in sets],
                "paths": [descend(t, ROOTS, LEVELS).view(np.int64) if len(t) else np.zeros(0, np.int64) for t in sets], "sketch": [sketch(t) for t in sets],
            })

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), word_hashes(text_or_empty(text_col)).alias("words"))
    built = rows.mapInPandas(build, "doc_id string, node long, size int, paths array<long>, sketch array<int>")
    return built.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def tokens_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, tokens) for the rows (node, doc_id) of ``wanted``, computed anew from the texts of those ids only."""
    def build(batches):
        for batch in (whole.iloc[i : i + SLICE] for whole in batches for i in range(0, len(whole), SLICE)):
            sets = [token_set(w) for w in batch["words"]]
            yield pd.DataFrame({"node": [set_digest(t) for t in sets], "tokens": [t.view(np.int64) for t in sets]})

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    words = keep_ids(texts, wanted, "doc_id", "left_semi").select(word_hashes(F.col("text")).alias("words"))
    found = words.where(F.size("words") > 0).mapInPandas(build, "node long, tokens array<long>")
    return found.join(small_side(wanted.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches may belong to sets over the least similarity: four standard deviations below it or more."""
    either = ((a != 0) | (b != 0)).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    return equal >= (SIMILAR - 1.6 / np.sqrt(np.maximum(either, 1))) * either


def link_bucket(batches):
    """Star edges (a, b) of the groups that the sketches of a bucket's sets form."""
    for batch in batches:
        out = []
        for nodes, sketches in zip(batch["nodes"], batch["sketches"]):
            nodes, S = np.asarray(nodes), np.stack([np.asarray(x) for x in sketches])
            if len(nodes) == 2:
                if similar(S[0], S[1]):
                    out.append((nodes[:1], nodes[1:]))
                continue
            root = roots_of(similar(S[:, None, :], S[None, :, :]))
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            out.append((nodes[linked], nodes[root[linked]]))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        yield pd.DataFrame({"a": a, "b": b})


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The first member of each index's component of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shares(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of the bins used by either of two sketches that agree, row by row."""
    return ((one == two) & (one != 0)).sum(axis=1) / np.maximum(((one != 0) | (two != 0)).sum(axis=1), 1)


def sketch_rows(column) -> np.ndarray:
    return np.stack([np.asarray(x) for x in column]) if len(column) else np.zeros((0, BINS), np.int32)


def judge_heads(batches):
    """For pairs of a set and the head of nodes that hold it: whether their sketches link them, and whether they are close."""
    for batch in batches:
        share = shares(sketch_rows(batch["sketch"]), sketch_rows(batch["head_sketch"]))
        yield pd.DataFrame({"node": batch["node"], "head": batch["head"], "paths": batch["paths"], "near": share >= NEAR, "close": share >= CLOSE})


def hot_heads(hot: DataFrame, nodes: DataFrame) -> tuple[np.ndarray, ...]:
    """Of the hot tree nodes, which are fewer than ``HOT_SHARE``: sorted paths, places of their two heads, heads, sketches."""
    paths = hot.select("path", "low", "high").toPandas().sort_values("path")
    some = materialise(hot.select(F.explode(F.array("low", "high")).alias("node")).distinct())
    heads = nodes.select("node", "sketch").join(F.broadcast(some), "node").toPandas().sort_values("node")
    ids = heads["node"].to_numpy(dtype=np.int64)
    return paths["path"].to_numpy(dtype=np.int64), np.searchsorted(ids, paths[["low", "high"]].to_numpy(dtype=np.int64)), ids, sketch_rows(heads["sketch"])


def part_with_hot(held, last: bool):
    """A function that takes sets (node, paths, sketch) out of hot tree nodes.

    It gives the heads that a set is near, the hot paths that it goes down from as it is close to neither head there, and its
    other paths.  In the last descent the former become edges to the smaller head instead.
    """
    def part(batches):
        hot, heads_at, heads, head_sketch = held.value
        for batch in batches:
            lists = [np.asarray(x) for x in batch["paths"]]
            of, path = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists])
            at = np.minimum(np.searchsorted(hot, path), max(0, len(hot) - 1))
            is_hot = hot[at] == path if len(hot) else np.zeros(len(path), bool)
            r, k = of[is_hot], at[is_hot]
            pair, back = np.unique(r[:, None] * max(1, len(heads)) + heads_at[k], return_inverse=True)
            row, head = pair // max(1, len(heads)), pair % max(1, len(heads))
            S, share = sketch_rows(batch["sketch"]), np.zeros(len(pair))
            for i in range(0, len(pair), 16384):
                share[i : i + 16384] = shares(S[row[i : i + 16384]], head_sketch[head[i : i + 16384]])
            stays = ~(share >= CLOSE)[back.reshape(len(r), 2)].any(axis=1)
            near = share >= NEAR
            if last:
                near[back.reshape(len(r), 2)[stays, 0]] = True
            deal = lambda rows, values: np.split(values, np.searchsorted(rows, np.arange(1, len(lists)))) if len(lists) else []
            down = np.zeros(0, np.int64) if last else path[is_hot][stays]
            yield pd.DataFrame({"node": batch["node"], "heads": deal(row[near], heads[head[near]]), "down": deal(r[stays][: len(down)], down), "rest": deal(of[~is_hot], path[~is_hot])})

    return part


def star_edges(near: DataFrame) -> DataFrame:
    """Edges (a, b) that connect each node with its ``heads``: one from its smallest head to it, and different ones from that
    head to the others, which are few as many nodes have the same heads."""
    first = F.array_min("heads")
    star = F.transform(F.array_sort("heads"), lambda h, i: F.struct(first.alias("a"), F.when(i == 0, F.col("node")).otherwise(h).alias("b")))
    return materialise(near.select(F.explode(star).alias("e")).select("e.a", "e.b").distinct())


def candidate_edges(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) that connect all sets which share a path and may be similar; ``nodes`` holds node, doc_id, paths, sketch.

    At a tree node with many sets, each is first compared with the node's smallest and largest, its heads.  Those near one
    are linked to it, and those close to one need not go further down from there: whatever is similar to them is near that
    head, and so linked to it as well.  So a large group of near copies leaves the tree at once, and only the others are split
    further.  The heads of hot nodes, fewer than ``HOT_SHARE``, are sent to all sets; the other nodes meet theirs in shuffles in
    which no path has more than a ``HOT_SHARE``-th of the rows.
    """
    sets, edges = nodes.select("node", "paths", "sketch"), None
    add = lambda found, more: more if found is None else found.unionByName(more)
    for descent in range(DESCENTS + 1):
        last = descent == DESCENTS
        each = sets.select("node", F.explode("paths").alias("path"))
        counts = materialise(each.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"))
        bound = max(BUCKET, sets.agg(F.coalesce(F.sum(F.size("paths")), F.lit(0))).first()[0] // HOT_SHARE)
        held = nodes.sparkSession.sparkContext.broadcast(hot_heads(counts.where(F.col("n") > bound), nodes))
        parted = materialise(sets.mapInPandas(part_with_hot(held, last), "node long, heads array<long>, down array<long>, rest array<long>"))
        edges = add(edges, star_edges(parted.select("node", "heads")))
        frontier = materialise(parted.select("node", F.explode("rest").alias("path")))

        small = frontier.join(counts.where(F.col("n") <= BUCKET).select("path").hint("merge"), "path")
        buckets = small.groupBy("path").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
        members = buckets.select(F.col("nodes"), F.explode("nodes").alias("node")).join(nodes.select("node", "sketch").hint("merge"), "node")
        filled = members.groupBy("nodes").agg(F.sort_array(F.collect_list(F.struct("node", "sketch"))).alias("m"))
        filled = filled.select(F.col("m.node").alias("nodes"), F.col("m.sketch").alias("sketches"))
        edges = edges.unionByName(materialise(filled.mapInPandas(link_bucket, "a long, b long").distinct()))

        large = counts.where((F.col("n") > BUCKET) & (F.col("n") <= bound))
        below = frontier.join(large.hint("merge"), "path").groupBy("node", "low", "high").agg(F.collect_list("path").alias("paths"))
        pairs = materialise(below.select("node", F.explode(F.array("low", "high")).alias("head"), "paths"))
        heads = materialise(pairs.select("head").distinct().join(nodes.select(F.col("node").alias("head"), F.col("sketch").alias("head_sketch")), "head"))
        compared = pairs.join(nodes.select("node", "sketch").hint("merge"), "node").join(small_side(heads), "head")
        judged = materialise(compared.mapInPandas(judge_heads, "node long, head long, paths array<long>, near boolean, close boolean"))
        edges = edges.unionByName(star_edges(judged.where("near").groupBy("node").agg(F.collect_set("head").alias("heads"))))
        stay = judged.groupBy("node", "paths").agg(F.max("close").alias("close"), F.min("head").alias("head")).where("not close")
        if last:
            # sets that share this many sampled tokens are candidates of each other; the exact comparison decides
            return edges.unionByName(stay.select(F.col("head").alias("a"), F.col("node").alias("b")))
        down = parted.where(F.size("down") > 0).select("node", "down").unionByName(stay.select("node", F.col("paths").alias("down")))
        seeds = materialise(down.groupBy("node").agg(F.flatten(F.collect_list("down")).alias("seeds")))
        if not seeds.limit(1).count():
            return edges
        texts = tokens_of(docs, materialise(seeds.join(nodes.select("node", "doc_id"), "node").select("node", "doc_id")), id_col, text_col)

        def deeper(batches):
            for batch in batches:
                kids = [descend(np.asarray(t).view(np.uint64), np.asarray(p).view(np.uint64), DEEPER).view(np.int64) for t, p in zip(batch["tokens"], batch["seeds"])]
                yield pd.DataFrame({"node": batch["node"], "paths": kids})

        found = texts.join(seeds, "node").mapInPandas(deeper, "node long, paths array<long>")
        sets = materialise(found.join(nodes.select("node", "sketch"), "node"))


def overlap_counts(left: list, right: list, same: bool) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, which may be the same ones (then a set's
    intersection with itself is not meant to be read).

    Tokens that only one side or one set has are left out; the others make 0/1 matrices, in slices of bounded size.
    """
    a, b = np.concatenate(left), np.concatenate(right)
    tokens, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = np.bincount(of[: len(a)], minlength=len(tokens)), np.bincount(of[len(a) :], minlength=len(tokens))
    keep = np.flatnonzero(in_a > 1 if same else (in_a > 0) & (in_b > 0))
    place = np.full(len(tokens), -1)
    place[keep] = np.arange(len(keep))
    rows_a, rows_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    at_a, at_b = place[of[: len(a)]], place[of[len(a) :]]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, len(keep), 4096):
        width = min(4096, len(keep) - first)
        A, B = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        for rows, at, M in ((rows_a, at_a, A), (rows_b, at_b, B)):
            some = (at >= first) & (at < first + width)
            M[rows[some], at[some] - first] = 1
        used_a, used_b = np.flatnonzero(A.any(axis=1)), np.flatnonzero(B.any(axis=1))
        out[np.ix_(used_a, used_b)] += A[used_a] @ B[used_b].T
    return out


def exact_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, links, root) of one pair of blocks: links counted exactly, and the first node that a node's links lead to."""
    one, two = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    pdf = pdf.sort_values("node")
    sets = [np.asarray(t) for t in pdf["tokens"]]
    nodes, block = pdf["node"].to_numpy(), pdf["block"].to_numpy()
    x, y = np.flatnonzero(block == one), np.flatnonzero(block == two)
    none = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    if not len(x) or not len(y):
        return none
    n = np.array([len(t) for t in sets], dtype=np.float64)
    both = overlap_counts([sets[i] for i in x], [sets[i] for i in y], one == two).astype(np.float64)
    close = both * (1 + SIMILAR) >= SIMILAR * (n[x][:, None] + n[y][None, :]) - 1e-6
    linked = np.zeros((len(nodes), len(nodes)), dtype=bool)
    linked[np.ix_(x, y)] = close
    linked |= linked.T
    np.fill_diagonal(linked, False)
    links = linked.sum(axis=1)
    some = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[some], "links": links[some].astype(np.int64), "root": nodes[roots_of(linked)[some]]}) if len(some) else none


def verify(docs: DataFrame, nodes: DataFrame, components: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, links, root) rows for the sets of candidate components; every pair of a component is compared exactly once.

    A component is dealt into blocks that bound both rows and tokens, and each pair of blocks is a task of its own.
    """
    sized = materialise(components.join(nodes.select("node", "doc_id", "size"), "node"))
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    dealt = sized.join(materialise(blocks), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = materialise(dealt.select("component", "node", "doc_id", "blocks", "block"))
    sets = tokens_of(docs, dealt.select("node", "doc_id"), id_col, text_col)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    spread = sets.join(dealt.drop("doc_id"), "node").withColumn("pair", F.explode(pairs))
    spread = spread.select("component", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "node", "block", "tokens")
    return spread.groupBy("component", "i", "j").applyInPandas(exact_links, "node long, links long, root long")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, copy_of, copies.

    ``class_id`` is the smallest id of the texts that links of similarity 0.8 or more connect, ``n_links`` the number of
    other shingle sets that the row's set links to, ``copy_of`` the smallest id with an equal set and ``copies`` the number
    of those rows.  A text of one to four words is a single shingle.  Null and empty texts have no shingles: such a row is a
    class of its own with no links, as is a row with a null id (class null).  Repeated rows are copies of each other; other
    columns are ignored; an empty table gives no rows.
    """
    rows = materialise(describe(docs, id_col, text_col))
    real = rows.where("node is not null and doc_id is not null")
    nodes = materialise(real.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")))
    found = materialise(verify(docs, nodes, connected(candidate_edges(docs, nodes, id_col, text_col)), id_col, text_col))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "doc_id", "copies").join(classes, "node", "left").join(links, "node", "left")
    known = materialise(known.withColumn("component", F.coalesce("component", "node")))
    names = known.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    named = split_join(known, materialise(names), "component", "members", max(1, known.count()))
    named = materialise(named.select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("doc_id").alias("copy_of"), "copies"))
    total = rows.count()
    placed = split_join(real.select("doc_id", "node"), named, "node", "copies", max(1, total)).select("doc_id", "class_id", "n_links", "copy_of", "copies")
    alone = rows.where("node is null or doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("copies")
    )
    return placed.unionByName(alone)
