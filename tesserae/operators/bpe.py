"""Byte-level pair encoding: pre-token counts, merges learnt from them, and encoding with given merges."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.storage import discard, materialise

#: Special tokens in the order of their ids, then come 256 bytes, then the merges; the public split pattern.
SPECIALS = (
    "<|endoftext|>", "<|unk|>", "<|pad|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|tool_call|>", "<|tool_result|>",
    "<|thinking|>", "<|json_start|>", "<|json_end|>",
)
EOS = 0
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-token types that the driver merges by itself, and slots of a usual one; where there are more slots, the executors begin.
DRIVER_TYPES, TYPE_SLOTS = 1_500_000, 12
#: Most frequent pairs of a pass over the executors' types among which merges are looked for.
TOP_PAIRS = 2_000
#: All counts over this are the first guess of the last merge's count; it was 1/346,000 and 1/323,000 of them on two tables.
LAST_SHARE = 1_500_000
#: Places of pairs that the driver sorts at once at its beginning, about.
FIRST_PLACES = 2_000_000
#: Slots without a symbol: between types, and within a longer symbol.  A pair is one number, its first id times WIDE and its second.
GAP, DEAD, WIDE = -1, -2, 1 << 32
#: The rank of a pair that no merge has.
NEVER = (1 << 31) - 1
#: Many types in a row: their slots and counts as bytes.
PACKED = "ids binary, n binary, slots long"
#: Pre-token types whose ids a worker remembers while it encodes, about, and texts whose new types it encodes together.
MEMORY, TEXTS = 500_000, 256


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def pretoken_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts."""
    return docs.select(F.explode(pretokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def learn_merges(counts: DataFrame, vocabulary: int = 32_000, driver_types: int = DRIVER_TYPES) -> list[tuple[int, int]]:
    """Pairs of ids in the order of their merging; the k-th makes id ``len(SPECIALS) + 256 + k``.

    The most frequent adjacent pair is merged, ties to the smaller pair, until the vocabulary is full or no pair is left.
    All types count.  While they have more symbols than ``driver_types`` usual ones they stay on the executors, where each
    pass merges as many pairs as are sure to come next; the driver merges the rest and updates only what a merge touches.

    What lies between two symbols is never merged once their pair is rarer than the last merge, as no later pair in that
    place is more frequent.  How frequent that one is is guessed from all counts; with a guess that proves too high no
    vocabulary gets full, and all is done again with a lower one.
    """
    counts, most = materialise(counts), vocabulary - len(SPECIALS) - 256
    total = counts.agg(F.sum("n")).first()[0] or 0
    floor = max(1, total // LAST_SHARE * 32_000 // max(1, vocabulary))
    while True:
        merges = merges_above(counts, most, floor, driver_types * TYPE_SLOTS)
        if len(merges) >= most or floor == 1:
            return merges
        floor = max(1, floor // 4)


def merges_above(counts: DataFrame, most: int, floor: int, room: int) -> list[tuple[int, int]]:
    """The first merges of pairs that come up ``floor`` times or more; the driver takes over at ``room`` slots."""
    merges: list[tuple[int, int]] = []
    words = materialise(counts.mapInArrow(packed_types, PACKED))
    while len(merges) < most:
        slots = words.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
        if slots <= room:
            ids, weights = gathered(words)
            discard(words)
            return merges + driver_merges(ids, weights, most - len(merges), len(merges), floor)
        pairs = words.select("ids", "n").mapInArrow(counted_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toPandas()
        if not len(pairs):
            break
        pair, n = pairs["pair"].to_numpy(), pairs["n"].to_numpy()
        top = np.lexsort((pair, -n))[:TOP_PAIRS]
        sure = sure_merges([divmod(x, WIDE) for x in pair[top].tolist()], most - len(merges))
        apply = merging(sure, len(SPECIALS) + 256 + len(merges), np.sort(pair))
        merges += sure
        before, words = words, materialise(words.select("ids", "n").mapInArrow(apply, PACKED))
        discard(before)
    discard(words)
    return merges


def with_gaps(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ids that lie end to end, with a gap before, between and after them."""
    out = np.full(len(ids) + len(lengths) + 1, GAP, dtype=np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = ids
    return out


def packed(ids: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """Slots of types and the types' counts as one row; ``gathered`` and the passes take it apart."""
    row = [pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([weights.astype(np.int64).tobytes()], pa.binary()), pa.array([len(ids)], pa.int64())]
    return pa.RecordBatch.from_arrays(row, names=["ids", "n", "slots"])


def unpacked(batches):
    for batch in batches:
        for ids, weights in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(ids.as_py(), np.int32), np.frombuffer(weights.as_py(), np.int64)


def packed_types(batches):
    """Rows of types, each with the bytes of up to a batch of (token, n); a type of one byte has no pair."""
    for batch in batches:
        raw = [t.encode("utf-8") for t in batch.column("token").to_pylist()]
        sizes, weights = np.fromiter(map(len, raw), np.int64, len(raw)), batch.column("n").to_numpy(zero_copy_only=False)
        some = sizes > 1
        if some.any():
            ids = np.frombuffer(b"".join(r for r in raw if len(r) > 1), np.uint8).astype(np.int32) + len(SPECIALS)
            yield packed(with_gaps(ids, sizes[some]), weights[some])


def gathered(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All packed types on the driver, a partition at a time."""
    ids, weights = [np.array([GAP], np.int32)], [np.zeros(0, np.int64)]
    for row in words.select("ids", "n").toLocalIterator():
        ids.append(np.frombuffer(row.ids, np.int32)[1:])  # each row begins with a gap, and the one before ends with one
        weights.append(np.frombuffer(row.n, np.int64))
    return np.concatenate(ids), np.concatenate(weights)


def counted_pairs(batches):
    """(pair, n) of each packed row: the places of pairs, weighted by their types' counts."""
    for ids, weights in unpacked(batches):
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        pair, where = np.unique(ids[at].astype(np.int64) * WIDE + ids[at + 1], return_inverse=True)
        word = np.cumsum(ids == GAP)[at] - 1
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, where, weights[word])
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])


def merging(sure: list[tuple[int, int]], new: int, alive: np.ndarray):
    """A pass over packed rows: types are cut between symbols whose pair is not in ``alive`` (sorted), and get the merges."""
    codes = np.array([a * WIDE + b for a, b in sure], dtype=np.int64)
    order = np.argsort(codes)
    codes, made, same = codes[order], (new + order).astype(np.int32), [a for a, b in sure if a == b]

    def found(pair: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, pair), len(among) - 1)
        return at, among[at] == pair

    def apply(batches):
        for ids, weights in unpacked(batches):
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            pair = ids[at].astype(np.int64) * WIDE + ids[at + 1]
            keep = found(pair, alive)[1]
            which, hit = found(pair, codes)
            first, which = at[hit], which[hit]
            if same:  # in a row of equal ids every second pair, from the left
                equal = np.flatnonzero(ids[first] == ids[first + 1])
                drop = equal[~alternate(first[equal], first[equal] + 1)]
                first, which = np.delete(first, drop), np.delete(which, drop)
            ids, bound = ids.copy(), np.ones(len(ids), dtype=bool)  # bound: nothing is merged over the end of a symbol
            bound[at[keep]] = False
            bound[first] = bound[first + 1]
            ids[first], ids[first + 1] = made[which], DEAD
            word = np.cumsum(ids == GAP) - 1
            real = ids >= 0
            ids, bound, word = ids[real], bound[real], word[real]
            ends = np.flatnonzero(bound)
            sizes = np.diff(ends, prepend=-1)
            some = sizes > 1
            if some.any():
                yield packed(with_gaps(ids[np.repeat(some, sizes)], sizes[some]), weights[word[ends[some]]])

    return apply


def alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Every second of the places that follow each other directly, from the first."""
    order = np.arange(len(at))
    begins = np.append(True, at[1:] != after[:-1])[: len(at)]
    return (order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0


def driver_merges(ids: np.ndarray, weights: np.ndarray, most: int, done: int = 0, floor: int = 1) -> list[tuple[int, int]]:
    """The first merges, after ``done`` earlier ones, of types with their counts, as long as a pair comes up ``floor`` times.

    All types lie in one array of slots with a gap around each.  A symbol is in its first slot, its length in its first and
    last.  A pair's places all come up in the merge that makes its newer id, so they are stored once and checked when the
    pair's turn comes; places of a pair below ``floor`` are cut for good.  A heap has an entry for each count that a pair
    came to have.
    """
    base, span, cut = len(SPECIALS), np.ones(len(ids), dtype=np.int32), np.zeros(len(ids), dtype=bool)
    word = np.cumsum(ids == GAP, dtype=np.int32)
    word -= 1
    where, counts, heap = {}, {}, []

    def grouped(places: np.ndarray):
        """The pairs that begin at some places, their counts, the bounds of their places, and the places."""
        code = ids[places].astype(np.int64)
        code *= WIDE
        code += ids[places + span[places]]
        order = np.argsort(code, kind="stable")
        code, places = code[order], places[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        return code[first], np.add.reduceat(weights[word[places]], first) if len(first) else first, np.append(first, len(code)), places

    def store(places: np.ndarray):
        pairs, sums, bounds, places = grouped(places)
        rare = sums < floor
        cut[places[np.repeat(rare, np.diff(bounds))]] = True
        for i in np.flatnonzero(~rare).tolist():
            pair, n = int(pairs[i]), int(sums[i])
            counts[pair], where[pair] = n, places[bounds[i] : bounds[i + 1]].copy()
            heappush(heap, (-n, pair))

    def before(places: np.ndarray) -> np.ndarray:
        return places - span[places - 1]

    def open_pairs(*places: np.ndarray) -> np.ndarray:
        """Those of the places at which an uncut pair begins, once each."""
        at = np.concatenate(places)
        return np.unique(at[(ids[at] >= 0) & ~cut[at] & (ids[at + span[at]] >= 0)])

    begins = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)).astype(np.int32)
    seen = np.bincount(ids[begins]) if len(begins) else np.zeros(0, np.int64)
    share = np.cumsum(seen) // FIRST_PLACES  # pairs are stored by ranges of their first ids, which bounds what is sorted at once
    for k in np.unique(share).tolist():
        store(begins[share[ids[begins]] == k])
    del begins
    merges: list[tuple[int, int]] = []
    while len(merges) < most and heap:
        n, best = heappop(heap)
        if -n != counts.get(best, 0):
            continue  # the count has changed since
        (left, right), new = divmod(best, WIDE), base + 256 + done + len(merges)
        merges.append((left, right))
        at = where.pop(best)
        del counts[best]
        at = at[ids[at] == left]
        at = at[ids[at + span[at]] == right]
        if left == right:  # in a row of equal ids every second pair, from the left
            at = at[alternate(at, at + span[at])]
        second = at + span[at]
        pairs, sums, _, _ = grouped(open_pairs(before(at), second))
        for pair, moved in zip(pairs.tolist(), sums.tolist()):
            if pair in counts:
                counts[pair] -= moved
                if counts[pair] >= floor:
                    heappush(heap, (-counts[pair], pair))
                else:
                    del counts[pair], where[pair]
        ids[at], ids[second], cut[at] = new, DEAD, cut[second]
        span[at] += span[second]
        span[at + span[at] - 1] = span[at]
        store(open_pairs(before(at), at))
    return merges


def sure_merges(top: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The longest beginning of the pairs in their order that merging one by one would choose too.

    Merging (a, b) changes only pairs that end in a or begin with b, and what it makes, (x, new) or (new, y), is no more
    frequent than the (x, a) or (b, y) it comes from.  So up to the first pair that an earlier one changes nothing can come
    between; a pair of equal ids changes itself and ends the row.
    """
    sure: list[tuple[int, int]] = []
    firsts, seconds = set(), set()
    for a, b in top[:most]:
        if a in seconds or b in firsts:
            break
        sure.append((a, b))
        if a == b:
            break
        firsts.add(a)
        seconds.add(b)
    return sure


def merge(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """All occurrences of a pair, from the left, as one id."""
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


class PairTable:
    """Ranks of merges by their pairs: a hash table in two arrays, a quarter full at most, with the next slots as overflow."""

    def __init__(self, codes: np.ndarray, ranks: np.ndarray):
        bits = max(4, (4 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.codes, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32)
        at = self.home(codes)
        while len(codes):
            free = np.flatnonzero(self.codes[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.codes[slots], self.ranks[slots] = codes[placed], ranks[placed]
            codes, ranks, at = np.delete(codes, placed), np.delete(ranks, placed), np.delete(at, placed) + 1 & self.mask

    def home(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NEVER."""
        codes = left.astype(np.int64) * WIDE + right
        at = self.home(codes)
        there = self.codes[at]
        out = np.where(there == codes, self.ranks[at], np.int32(NEVER))
        open_ = np.flatnonzero((there != codes) & (there >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            there = self.codes[at[open_]]
            hit = there == codes[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def type_arrays(tokens: list[str], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all tokens end to end, and how many each has.

    In each round every token gets its first merge at all its places, as it would alone; only pairs beside a merge are looked
    up again.
    """
    raw = [t.encode("utf-8") for t in tokens]
    ids = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + np.int32(len(SPECIALS))
    word, done = np.repeat(np.arange(len(raw), dtype=np.int32), np.fromiter(map(len, raw), np.int64, len(raw))), []

    def ranks(at: np.ndarray) -> np.ndarray:
        """Of the pairs that begin at some places before the last."""
        return np.where(word[at + 1] == word[at], table.find(ids[at], ids[at + 1]), np.int32(NEVER))

    made = np.append(ranks(np.arange(len(ids) - 1)), np.int32(NEVER)) if len(ids) else ids
    while len(ids):
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes, least = np.diff(begin, append=len(ids)), np.minimum.reduceat(made, begin)
        least = np.repeat(least, sizes)
        ready = least == NEVER
        if ready.any():
            done.append((word[ready], ids[ready]))
            ids, word, made, least = ids[~ready], word[~ready], made[~ready], least[~ready]
        first = np.flatnonzero(made == least)
        first = first[alternate(first, first + 1)]  # in a row of equal ids every second pair, from the left
        ids[first] = made[first] + np.int32(len(SPECIALS) + 256)
        keep = np.ones(len(ids), dtype=bool)
        keep[first + 1] = False
        ids, word, made = ids[keep], word[keep], made[keep]
        first -= np.arange(len(first))
        made[first] = NEVER
        beside = np.concatenate([first - 1, first])
        beside = beside[(beside >= 0) & (beside < len(ids) - 1)]
        made[beside] = ranks(beside)
    words = np.concatenate([w for w, _ in done]) if done else word
    flat = np.concatenate([x for _, x in done]) if done else ids
    return flat[np.argsort(words, kind="stable")].astype(np.int64), np.bincount(words, minlength=len(raw))


def type_ids(tokens: list[str], codes: np.ndarray, rank: np.ndarray) -> list[list[int]]:
    """The ids of each token, given the merges' pairs, sorted, and their ranks."""
    flat, sizes = type_arrays(tokens, PairTable(codes, rank))
    ends = np.cumsum(sizes).tolist()
    flat = flat.tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class TypeMemory(dict):
    """Pre-token types to their numbers; types that are new are numbered as they come, and get their ids by ``learn``."""

    def __init__(self, table: PairTable, fixed: dict[str | None, int]):
        super().__init__(zip(fixed, range(len(fixed))))
        self.table, self.new = table, []
        self.flat, self.begin = np.array(list(fixed.values()), dtype=np.int64), np.arange(len(fixed) + 1)

    def __missing__(self, token: str) -> int:
        self.new.append(token)
        self[token] = n = len(self)
        return n

    def learn(self) -> None:
        if self.new:
            flat, sizes = type_arrays(self.new, self.table)
            self.flat, self.begin = np.concatenate([self.flat, flat]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.new = []

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts end to end, and where each text's end."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        types = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(ends[-1]) if len(ends) else 0)
        self.learn()
        begin = self.begin[types]
        sizes = self.begin[types + 1] - begin
        after = np.append(0, np.cumsum(sizes))
        return self.flat[np.arange(after[-1]) + np.repeat(begin - after[:-1], sizes)], after[ends]


def encode(docs: DataFrame, merges: list[tuple[int, int]], eos: int | None = EOS) -> DataFrame:
    """Column ``ids`` added: the ids of each text, then ``eos``; special tokens in a text are one id each."""
    held = docs.sparkSession.sparkContext.broadcast(np.array(merges, dtype=np.int64).reshape(-1, 2))

    @F.arrow_udf("array<long>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        split = regex.compile(SPLIT.removeprefix("(?U)"))
        special = regex.compile("(" + "|".join(map(regex.escape, SPECIALS)) + ")")
        table = PairTable(held.value[:, 0] * WIDE + held.value[:, 1], np.arange(len(held.value)))
        end, fixed = [None] if eos is not None else [], {s: i for i, s in enumerate(SPECIALS)} | ({None: eos} if eos is not None else {})
        known = TypeMemory(table, fixed)

        def tokens_of(text: str) -> list[str]:
            if "<|" not in text:
                return split.findall(text) + end
            return [t for part in special.split(text) for t in ([part] if part in SPECIALS else split.findall(part))] + end

        for batch in batches:
            flat, ends = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for first in range(0, len(batch), TEXTS):
                if len(known) > MEMORY:
                    known = TypeMemory(table, fixed)
                ids, some = known.ids([tokens_of(t or "") for t in batch.slice(first, TEXTS).to_pylist()])
                flat.append(ids)
                ends.append(ends[-1][-1] + some)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(flat)))

    # a condition on the ids would be moved below them and encode once more for itself, if Spark took them for deterministic
    return docs.withColumn("ids", ids_of.asNondeterministic()("text"))


def decode(ids: list[int], merges: list[tuple[int, int]]) -> str:
    """The text of some ids; special ids give their strings."""
    pieces = [s.encode() for s in SPECIALS] + [bytes([b]) for b in range(256)]
    for a, b in merges:
        pieces.append(pieces[a] + pieces[b])
    return b"".join(pieces[i] for i in ids).decode("utf-8", "replace")
