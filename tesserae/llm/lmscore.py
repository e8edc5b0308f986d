"""Language-model scores of whole texts: a causal self-attention model on subword ids, and a word-frequency baseline.

The model predicts a class of subwords from the context, and the subword from its class by its frequency in the corpus after
the subword before.  Frequencies, vocabulary and baseline come from all training texts; the weights are trained first on a bounded sample of
windows and then by rounds in which every partition trains on the windows of its own texts and the weights are averaged.
"""

from __future__ import annotations

import base64
import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import attention as A
from tesserae.llm import graph
from tesserae.llm.common import WORD, id_crc, text_or_empty
from tesserae.storage import hash_sample, materialise

#: A public tokenizer's ranks; read on the driver and sent along, so executors need no such file.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: What is encoded at a time: bounded runs, so a text without white space takes linear time.
PIECE = r" ?\p{L}{1,40}| ?\p{N}{1,8}| ?[^\s\p{L}\p{N}]{1,16}|\s"
#: Classes that hold one frequent subword each, the end among them; the others share the rest by rank, half of them those
#: that begin a word.
SINGLE = 112
#: Weight of a subword's frequency in its class against its frequency after the subword before.
BACKOFF = 10.0
#: Frequent words whose counts are broadcast; windows of the first training; windows a text gives to it; rounds of averaging.
HOT_WORDS, SAMPLE_WINDOWS, WINDOWS_PER_TEXT, ROUNDS = 65_536, 40_000, 4, 1
#: Passes of the first training, and characters on either side of its windows' place that are encoded.
EPOCHS, REACH = 4, 350
#: Windows that are shuffled together in the rounds.
POOL = 4096
#: Words that a worker remembers the subwords of, blocks scored at a time, and texts and characters laid out together.
MEMORY, BLOCKS, TEXTS, CHARACTERS = 300_000, 256, 256, 1 << 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SEED = 42  # of the engine's xxhash64


@dataclass
class Vocabulary:
    """Per subword id: input id, class, and log probability within the class; pairs (before, subword, n) by input id."""

    ranks: bytes
    end: int
    input_id: np.ndarray
    klass: np.ndarray
    log_in_class: np.ndarray
    class_log_share: np.ndarray
    pairs: np.ndarray

    def after(self) -> tuple[np.ndarray, np.ndarray]:
        """Log probability within its class of each input id (column) after each input id (row), and the log share of each
        class (column) that is backed off after each input id (row).

        A subword's frequency after that id is backed off to its frequency in the class; subwords that share the last input
        id are never counted after another, so theirs is the latter times the share.  So each class sums to one.
        """
        known = np.flatnonzero(self.input_id < A.INPUTS - 1)
        column, klass = self.input_id[known], np.zeros(A.INPUTS, dtype=np.int64)
        klass[column] = self.klass[known]
        alone = np.zeros(A.INPUTS)
        alone[column] = self.log_in_class[known]
        before, to, n = self.pairs
        seen = np.zeros((A.INPUTS, A.CLASSES))
        np.add.at(seen, (before, klass[to]), n)
        out = np.empty((A.INPUTS, A.INPUTS), dtype=np.float32)
        share = np.log(BACKOFF / (seen + BACKOFF))
        for row in range(A.INPUTS):
            out[row] = alone + share[row, klass]
        out[before, to] = np.log((n + BACKOFF * np.exp(alone[to])) / (seen[before, klass[to]] + BACKOFF))
        return out, share.astype(np.float32)

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What ``after`` gives, made once where the vocabulary is kept."""
        return self.after()

    def inside(self, stream: np.ndarray, after: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Log probability within its class of each subword of a stream after the one before it; the first has none before."""
        inputs, klass = self.input_id[stream], self.klass[stream]
        out = self.log_in_class[stream]
        out[1:] = np.where(inputs[1:] < A.INPUTS - 1, after[inputs[:-1], inputs[1:]], out[1:] + share[inputs[:-1], klass[1:]])
        return out


def words_of(text: str) -> list[str]:
    """Bytes are translated as that is faster; no other character's UTF-8 has bytes of A to Z."""
    return WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))


def byte_words(text: str) -> list[bytes]:
    """The words of ``words_of`` as UTF-8; bytes are split at just the white space that its pattern leaves out, and faster."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_column(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def word_hash(word: bytes) -> int:
    """What ``xxhash64`` gives for the word in SQL."""
    h = xxhash.xxh64_intdigest(word, seed=SEED)
    return h - (1 << 64) if h >> 63 else h


class Numbers(dict):
    """Gives each new key the next number, and lists the keys."""

    def __init__(self):
        self.keys_seen: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.keys_seen.append(key)
        return n


class Encoder:
    """Words as UTF-8 to subword ids, remembered until there are ``MEMORY`` of them, as one growing array with offsets."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=PIECE, mergeable_ranks=pairs, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self.bytes = np.zeros(max(pairs.values()) + 1, dtype=np.int64)
        self.bytes[list(pairs.values())] = list(map(len, pairs))
        self.forget()

    def forget(self) -> None:
        self.index = Numbers()
        self.words = self.index.keys_seen
        self.flat, self.begin, self.done = np.empty(1 << 16, dtype=np.int32), np.zeros(1 << 15, dtype=np.int64), 0

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        """Indices of words in this memory."""
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of all words, and how many each has.

        They are encoded as one text: no piece holds a space that it does not begin with, so none reaches into the next word,
        and the subwords' bytes tell where the words end.
        """
        text = (b" " + b" ".join(words)).decode("utf-8", "surrogatepass")
        try:
            text.encode()
        except UnicodeEncodeError:  # half a character, for which the encoder puts another
            each = [self.encode(" " + w.decode("utf-8", "surrogatepass")) for w in words]
            return np.array([x for e in each for x in e], dtype=np.int32), np.array(list(map(len, each)), dtype=np.int64)
        found = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        ends = np.searchsorted(np.cumsum(self.bytes[found]), np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)) + 1
        return found, np.diff(ends, prepend=0)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """All remembered subwords in one array, and where each word's begin."""
        n, used = len(self.words), int(self.begin[self.done])
        if n > self.done:
            found, lengths = self.encode_all(self.words[self.done :])
            self.flat, self.begin = room_for(self.flat, used + len(found)), room_for(self.begin, n + 1)
            self.flat[used : used + len(found)] = found
            self.begin[self.done + 1 : n + 1] = used + np.cumsum(lengths)
            self.done, used = n, used + len(found)
        return self.flat[:used], self.begin[: n + 1]


def room_for(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy of twice the room if it has not got ``n`` places."""
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


@functools.lru_cache(maxsize=1)
def remembering(ranks: bytes) -> Encoder:
    """An encoder that a worker keeps from task to task."""
    return Encoder(ranks)


def subword_stream(words: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The subwords of a sequence of remembered words."""
    lengths = begin[words + 1] - begin[words]
    ends = np.cumsum(lengths)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[words] - (ends - lengths), lengths)]


def windows_of(stream: np.ndarray, vocabulary: Vocabulary, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, their validity and target subwords (-1: none) of some blocks of an (end + text + end) stream."""
    at = blocks[:, None] * A.STRIDE + np.arange(A.WINDOW)[None, :] - (A.WINDOW - A.STRIDE)
    inputs = vocabulary.input_id[stream[np.clip(at, 0, len(stream) - 1)]]
    to = at[:, A.WINDOW - A.STRIDE :] + 1
    target = np.where(to < len(stream), stream[np.minimum(to, len(stream) - 1)], -1)
    return inputs, at >= 0, target


@dataclass
class Layout:
    """Streams (end + text + end) of some texts in rows of ``STRIDE`` places, each after a row that none of its windows sees.

    A stream begins a row, so a window is two rows and its targets are one row a place later; a last end may be the first
    place of the row before the next stream.  ``slots`` are subwords (-1: none), ``late`` a block's second row, ``of`` its text.
    """

    slots: np.ndarray
    late: np.ndarray
    of: np.ndarray
    inputs: np.ndarray
    klass: np.ndarray

    def windows(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, their validity and target classes (-1: none) of some blocks."""
        late, rows = self.late[begin:end], self.inputs.reshape(-1, A.STRIDE)
        valid = np.ones((len(late), A.WINDOW), dtype=bool)
        valid[:, : A.WINDOW - A.STRIDE] = (np.diff(self.of[max(0, begin - 1) : end], prepend=[-1] * (begin == 0)) == 0)[:, None]
        return np.concatenate([rows[late - 1], rows[late]], axis=1), valid, self.later(self.klass)[late]

    @staticmethod
    def later(places: np.ndarray) -> np.ndarray:
        """Rows that begin a place later."""
        return places[1 : len(places) - A.STRIDE + 1].reshape(-1, A.STRIDE)


def lay_out(found: list[np.ndarray], encoder: Encoder, v: Vocabulary) -> Layout:
    """Of texts given as arrays of remembered words."""
    pieces, begin = encoder.arrays()
    words = np.concatenate([np.zeros(0, np.int64), *found])
    inner = np.bincount(np.repeat(np.arange(len(found)), list(map(len, found))), begin[words + 1] - begin[words], len(found)).astype(np.int64)
    blocks = -(-(inner + 1) // A.STRIDE)
    before = np.cumsum(blocks + 1) - (blocks + 1)  # the row before each stream
    rows = int((blocks + 1).sum()) + 1
    start = (before + 1) * A.STRIDE
    slots = np.full(rows * A.STRIDE, -1, dtype=np.int32)
    slots[start] = slots[start + inner + 1] = v.end
    stream = subword_stream(words, pieces, begin)
    slots[np.arange(len(stream)) + np.repeat(start + 1 - (np.cumsum(inner) - inner), inner)] = stream
    late = np.ones(rows - 1, dtype=bool)
    late[before] = False
    klass = np.where(slots >= 0, v.klass[slots], -1).astype(np.int32)
    return Layout(slots, np.flatnonzero(late), np.repeat(np.arange(len(found)), blocks), v.input_id[slots], klass)


def groups(texts) -> list[tuple[int, int]]:
    """Ranges of consecutive texts that are laid out together."""
    cuts, size = [0], 0
    for i, text in enumerate(texts):
        if i > cuts[-1] and (i - cuts[-1] >= TEXTS or size + len(text) > CHARACTERS):
            cuts.append(i)
            size = 0
        size += len(text)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(texts)]) if b > a]


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) over all training texts, the end of a text being the empty word; materialised."""
    training = docs.where(id_crc(id_col) % 7 != 2).select(F.explode(F.concat(word_column(text_or_empty(text_col)), F.array(F.lit("")))).alias("word"))
    return materialise(training.groupBy("word").agg(F.count("*").alias("n")))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words whose count reaches the smallest bound that at most ``most`` words reach."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).where("n > 1").collect()  # a row per different count
    bound, words = None, 0
    for n, some in sorted(map(tuple, sizes), reverse=True):
        words += some
        if words > most:
            break
        bound = n
    return counts.where(F.col("n") >= bound) if bound else counts.where("word = ''")


def build_vocabulary(counts: DataFrame, ranks: bytes) -> Vocabulary:
    """Input ids and classes from subword frequencies; they are summed on the executors, a row per subword comes back."""
    spark = counts.sparkSession
    held = spark.sparkContext.broadcast(ranks)

    def split(batches):
        encoder = remembering(held.value)
        most = len(encoder.bytes)
        for batch in batches:
            ends, words = batch["word"] == "", batch[batch["word"] != ""]
            found, lengths = encoder.encode_all([w.encode() for w in words["word"]]) if len(words) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            before = np.concatenate([[-1], found[:-1]]).astype(np.int64)[: len(found)]
            before[np.cumsum(lengths) - lengths] = -1
            key, at = np.unique((before + 1) * most + found, return_inverse=True)
            sums = np.zeros(len(key), dtype=np.int64)
            np.add.at(sums, at, np.repeat(words["n"].to_numpy(), lengths))
            last = [[-1], [-2], [batch["n"][ends].sum()]] if ends.any() else [[], [], []]
            yield pd.DataFrame({"before": np.append(key // most - 1, last[0]), "piece": np.append(key % most, last[1]), "n": np.append(sums, last[2])}).astype("int64")

    pairs = materialise(counts.mapInPandas(split, "before int, piece int, n long").groupBy("before", "piece").agg(F.sum("n").alias("n")))
    got = pairs.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    tokens = {int(i): base64.b64decode(t) for t, i in (line.split() for line in ranks.splitlines() if line)}
    end = max(tokens) + 1
    n = np.zeros(end + 1)
    piece = got["piece"].to_numpy()
    n[np.where(piece < 0, end, piece)] = got["n"].to_numpy()
    order = np.lexsort((np.arange(end + 1), -n))
    order = np.concatenate([[end], order[order != end]])
    input_id, klass = np.full(end + 1, A.INPUTS - 1, dtype=np.int64), np.empty(end + 1, dtype=np.int64)
    input_id[order[: A.INPUTS - 1]] = np.arange(A.INPUTS - 1)
    klass[order[:SINGLE]] = np.arange(SINGLE)
    rest, bands = order[SINGLE:], (A.CLASSES - SINGLE) // 2
    begins = np.array([tokens.get(int(i), b"")[:1] == b" " for i in rest])
    for k, some in enumerate((rest[begins], rest[~begins])):
        band = np.log2(1 + np.arange(len(some)) / 8) * bands / 10
        klass[some] = SINGLE + k * bands + np.minimum(bands - 1, band.astype(np.int64))
    smooth = n + 1
    total = np.bincount(klass, smooth, A.CLASSES)
    within = pairs.where("before >= 0").toPandas()  # at most INPUTS squared rows that are of use, and far fewer
    ids = np.stack([input_id[within["before"]], input_id[within["piece"]]]) if len(within) else np.zeros((2, 0), np.int32)
    use = (ids < A.INPUTS - 1).all(axis=0)
    known = np.concatenate([ids[:, use], within["n"].to_numpy()[None, use]]).astype(np.int64)
    return Vocabulary(ranks, end, input_id, klass, np.log(smooth / total[klass]), np.log(np.maximum(total, 1) / total.sum()).astype(np.float32), known)


def training_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, text) of every training text."""
    return docs.where(id_crc(id_col) % 7 != 2).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), text_or_empty(text_col).alias("text"))


def first_windows(texts: DataFrame, vocabulary) -> DataFrame:
    """(h, ids, valid, target): adjacent windows of some of the training texts, at a place that a hash picks, end to end in
    one array each."""
    def cut(batches):
        v = vocabulary.value
        encoder = remembering(v.ranks)
        for batch in batches:
            out = []
            for h, text in zip(batch["h"], batch["text"]):
                if len(encoder.words) > MEMORY:
                    encoder.forget()
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                at = int(rng.integers(0, max(1, len(text))))
                low, high = max(0, at - REACH), at + REACH
                words = byte_words(text[low:high])
                words = words[int(low > 0) : len(words) - int(high < len(text))]  # without words that the ends cut
                ids = np.concatenate([[v.end] * (low == 0), subword_stream(encoder.word_ids(words), *encoder.arrays()), [v.end] * (high >= len(text))]).astype(np.int64)
                if len(ids) > 1:
                    blocks = -(-(len(ids) - 1) // A.STRIDE)
                    first = int(rng.integers(0, max(1, blocks - WINDOWS_PER_TEXT + 1)))
                    inputs, valid, target = windows_of(ids, v, np.arange(first, min(blocks, first + WINDOWS_PER_TEXT)))
                    out.append((h, inputs.ravel(), valid.ravel(), np.where(target >= 0, v.klass[target], -1).ravel().astype(np.int32)))
            yield pd.DataFrame(out, columns=["h", "ids", "valid", "target"])

    sample = hash_sample(texts, "h", SAMPLE_WINDOWS // WINDOWS_PER_TEXT)
    return sample.mapInPandas(cut, "h long, ids array<int>, valid array<boolean>, target array<int>")


def pools(batches, vocabulary: Vocabulary):
    """Inputs, their validity and target classes of all windows of all texts of some batches, about ``POOL`` at a time."""
    encoder, held, n = remembering(vocabulary.ranks), [], 0
    for batch in batches:
        texts = list(batch["text"])
        for begin, end in groups(texts):
            if len(encoder.words) > MEMORY:
                encoder.forget()
            laid = lay_out([encoder.word_ids(byte_words(t)) for t in texts[begin:end]], encoder, vocabulary)
            for first in range(0, len(laid.late), POOL):
                held.append(laid.windows(first, first + POOL))
                n += len(held[-1][0])
                if n >= POOL:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def as_arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    join = lambda name, kind, width: np.concatenate([np.zeros(0, kind), *pdf[name]]).astype(kind).reshape(-1, width)
    return join("ids", np.int32, A.WINDOW), join("valid", bool, A.WINDOW), join("target", np.int32, A.STRIDE)


def train_weights(texts: DataFrame, vocabulary: Vocabulary, shared) -> np.ndarray:
    """Weights from a bounded sample on the driver, then averaged over what the partitions learn from all windows."""
    spark = texts.sparkSession
    sample = first_windows(texts, shared).toPandas().sort_values("h")
    flat = A.train(A.initial(vocabulary.class_log_share), *as_arrays(sample), epochs=EPOCHS, rate=0.01, gradient=graph.fastest()[0])
    part = 4096
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(flat)

        def learn(batches):
            learner = A.Learner(held.value, rate=0.002, gradient=graph.fastest()[0])
            for pool in pools(batches, shared.value):
                learner.learn(*pool)
            if learner.seen:
                moved, n = learner.flat.astype(np.float64) * learner.seen, learner.seen
                yield pd.DataFrame({"at": np.arange(0, len(moved), part), "n": n, "sums": [moved[i : i + part] for i in range(0, len(moved), part)]})

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": pdf["at"].iloc[:1], "w": [np.sum(np.stack(list(pdf["sums"])), axis=0) / pdf["n"].sum()]})

        got = texts.mapInPandas(learn, "at long, n long, sums array<double>").groupBy("at").applyInPandas(mean, "at long, w array<double>")
        got = got.toPandas().sort_values("at")
        if len(got):
            flat = np.concatenate(list(got["w"])).astype(np.float32)
    return flat


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words, A to Z lower-cased, and one end; ``base_score`` and ``score`` are log10 probabilities of
    all of them.  Held out are ids whose crc32 as text is 2 modulo 7; all learning is from the others.  A null text is the
    empty text, which is one end; repeated rows score alike; other columns are ignored; an empty table gives no rows.

    Counts of frequent words, a bounded number, are broadcast; the rest of each text's words meet their counts in a shuffle
    by hash, in which no key is frequent.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        ranks = f.read()
    counts = count_words(docs, id_col, text_col)
    n_all, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = most_frequent(counts, HOT_WORDS).toPandas()
    vocabulary = build_vocabulary(counts, ranks)
    shared = spark.sparkContext.broadcast(vocabulary)
    flat = train_weights(training_texts(docs, id_col, text_col), vocabulary, shared)
    model = spark.sparkContext.broadcast((flat, dict(zip((w.encode() for w in hot["word"]), hot["n"].tolist()))))

    def score(batches):
        flat, known = model.value
        v, scorer, encoder = shared.value, graph.fastest()[1](flat), remembering(shared.value.ranks)
        log_known, hashes = np.zeros(0), np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids, texts = batch["doc_id"], list(batch["text"])
            for begin, end in groups(texts):
                if len(encoder.words) > MEMORY:
                    encoder.forget()
                    log_known, hashes = log_known[:0], hashes[:0]
                found = [encoder.word_ids(byte_words(t)) for t in texts[begin:end]]
                new = encoder.words[len(log_known) :]
                counted = np.array([known.get(w, 0) for w in new], dtype=np.int64)
                log_known = np.append(log_known, np.where(counted > 0, np.log10(counted + 1), -1.0))
                hashes = np.append(hashes, np.array([0 if n else word_hash(w) for w, n in zip(new, counted.tolist())], dtype=np.int64))
                yield rows_of(ids.iloc[begin:end], found, v, scorer, encoder, log_known, hashes, known.get(b"", 0))

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    scored = texts.mapInPandas(score, f"doc_id {kind}, n_tokens long, hot_known long, hot_sum double, cold array<long>, score double")
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = counts.select(F.xxhash64("word").alias("cold"), "n")
    met = scored.select("row", F.explode("cold").alias("cold")).join(rare.hint("merge"), "cold")
    sums = met.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("cold_sum"), F.count("*").alias("cold_known"))
    each = float(np.log10(n_all + distinct + 1))
    return scored.drop("cold").join(sums, "row", "left").select(
        "doc_id", (id_crc() % 7 == 2).alias("held_out"), "n_tokens", (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )


def rows_of(ids, found: list[np.ndarray], v: Vocabulary, scorer, encoder: Encoder, log_known: np.ndarray, hashes: np.ndarray, ends: int) -> pd.DataFrame:
    """The result rows of some texts, given as arrays of remembered words; their blocks are scored together."""
    hot_known, hot_sum, cold = [], [], []
    for words in found:
        logs = log_known[words]
        hot = logs >= 0
        hot_known.append(int(np.count_nonzero(hot)) + (ends > 0))
        hot_sum.append(float(logs[hot].sum() + np.log10(ends + 1)))
        cold.append(hashes[words[~hot]])
    laid = lay_out(found, encoder, v)
    inside = laid.later(v.inside(laid.slots, *v.tables))
    out = np.zeros(len(found))
    for i in range(0, len(laid.late), BLOCKS):
        inputs, valid, target = laid.windows(i, i + BLOCKS)
        got = scorer.block_scores(inputs, valid, np.maximum(target, 0)) + inside[laid.late[i : i + BLOCKS]]
        out += np.bincount(laid.of[i : i + BLOCKS], (got * (target >= 0)).sum(axis=1), len(found))
    return pd.DataFrame({"doc_id": ids.to_numpy(), "n_tokens": [len(w) + 1 for w in found], "hot_known": hot_known, "hot_sum": hot_sum, "cold": cold, "score": out / np.log(10)})
