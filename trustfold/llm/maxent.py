"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A token is drawn in two steps: its class given the words before it, then the
word given its class. The class has a softmax whose weights are the sum of rows
of a hashed table, one row for each feature of the context: the word before
(bigram), the two before (trigram), and the words two and three back alone
(skips). The most frequent words are classes of their own, all other words
share classes by the hash of their ending, so every word has a class, known or
not. Within its class a word has its smoothed share of the class's training
tokens; each class keeps one share for unknown words.

Texts are tokenised and their words hashed once; counting, training and scoring
read the stored runs of tokens. Word counts come from all training texts: the frequent words' are broadcast,
up to a fixed number, the rest are joined. Training passes over the training
texts in rounds of disjoint parts: each task starts from the round's weights,
takes gradient steps over its texts, and emits its changes with their counts;
the changes are averaged by feature over all tasks. The weights have a fixed
size whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.llm.common import row_key, stored


@dataclass(frozen=True)
class Settings:
    """Sizes of the model; none depends on the corpus."""

    single: int = 23  # frequent words that are classes of their own; the end of the text is another
    endings: int = 24  # classes of the other words
    named: int = 4096  # words that features know by name; others by class
    rows_log2: int = 14  # rows of the hashed weight table
    rounds: int = 3
    step: float = 1.2
    damping: float = 20.0
    batch: int = 4096  # tokens a gradient step
    frequent: int = 1 << 18  # words whose counts may be broadcast

    @property
    def classes(self) -> int:
        return 1 + self.single + self.endings

    @property
    def rows(self) -> int:
        return 1 << self.rows_log2


END = b""  # no word is empty
FEATURES = 4
_BLOCK = 256  # weight rows in one shuffled value


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


# --- tokens -------------------------------------------------------------------


@dataclass
class Tokens:
    """Texts as one run of tokens: ``code`` indexes ``words``; text i is starts[i]..starts[i + 1], its last token the end."""

    code: np.ndarray
    starts: np.ndarray
    words: list[bytes] | None  # not kept in stored runs
    hashes: np.ndarray | None = None  # of the words
    own: np.ndarray | None = None  # their classes by ending, 0 for the end


def tokenise(texts: pa.Array) -> Tokens:
    """Lower-cased (A-Z) runs of anything but ASCII white space, then one end, for each text; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.cast(pa.binary()).to_pylist()
    code = np.asarray(flat.indices).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    blank = words.index(b"") if b"" in words else -1
    if blank >= 0:  # white space at either end of a text
        owner, code = owner[code != blank], code[code != blank]
        words[blank] = END
    else:
        blank = len(words)
        words.append(END)
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(starts[-1], blank, dtype=np.int64)
    ends = np.zeros(starts[-1], dtype=bool)
    ends[starts[1:] - 1] = True
    out[~ends] = code
    return Tokens(out, starts, words)


@cache
def _ending_hash(ending: bytes) -> int:  # of at most two bytes
    return xxhash.xxh32_intdigest(ending)


def ending_class(word: bytes, s: Settings) -> int:
    return 1 + s.single + _ending_hash(word[-2:]) % s.endings


def hashed(t: Tokens, s: Settings) -> Tokens:
    """``t`` with the hash and the class by ending of each word."""
    if t.hashes is None:
        t.hashes = np.array([word_hash(w) for w in t.words], dtype=np.int64)
        t.own = np.array([0 if w == END else ending_class(w, s) for w in t.words], dtype=np.int64)
    return t


def token_runs(rows: DataFrame, s: Settings) -> DataFrame:
    """One row for the texts of one batch and part of ``rows`` (row, part, text): their keys, sizes in tokens, tokens as
    places among the run's distinct words, and those words' hashes and classes by ending, each as the bytes of an array."""

    def run(batches):
        for b in batches:
            t = hashed(tokenise(b.column("text")), s)
            key, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "part"))
            sizes = np.diff(t.starts)
            for p in np.unique(part):
                code = t.code[np.repeat(part == p, sizes)]
                used = np.bincount(code, minlength=len(t.hashes)) > 0
                place = (np.cumsum(used) - 1).astype(_code_type(int(used.sum())))
                arrays = {"rows": key[part == p], "sizes": sizes[part == p].astype(np.int64), "codes": place[code],
                          "hashes": t.hashes[used], "own": t.own[used].astype(np.uint16)}
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}})

    return rows.select("row", "part", "text").mapInArrow(run, "part int, rows binary, sizes binary, codes binary, hashes binary, own binary")


def _code_type(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def read_runs(batch: pa.RecordBatch):
    """The Tokens of each row of ``token_runs``."""
    for sizes, codes, hashes, own in zip(*(batch.column(c) for c in ("sizes", "codes", "hashes", "own"))):
        sizes, hashes = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (sizes, hashes))
        code = np.frombuffer(codes.as_buffer(), dtype=_code_type(len(hashes))).astype(np.int64)
        yield Tokens(code, np.concatenate([[0], np.cumsum(sizes)]), None, hashes, np.frombuffer(own.as_buffer(), dtype=np.uint16).astype(np.int64))


# --- counts -------------------------------------------------------------------


def run_counts(runs: DataFrame) -> DataFrame:
    """(word, ending, n): tokens of the ``runs`` by the word's hash, with its ending's class; the end is a word."""

    def run(batches):
        for b in batches:
            for t in read_runs(b):
                yield pa.RecordBatch.from_pydict({"word": pa.array(t.hashes), "ending": pa.array(t.own, pa.int32()),
                                                  "n": pa.array(np.bincount(t.code, minlength=len(t.hashes)), pa.int64())})

    rows = runs.select("sizes", "codes", "hashes", "own").mapInArrow(run, "word long, ending int, n long")
    return rows.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def word_counts(texts: DataFrame, s: Settings) -> DataFrame:
    """``run_counts`` of the training ``texts`` (text)."""
    return run_counts(token_runs(texts.select(F.lit(0).cast("long").alias("row"), F.lit(0).alias("part"), "text"), s))


@dataclass
class Lexicon:
    """What tasks know of words: arrays sorted by hash, of at most Settings.frequent words, and figures of the classes."""

    word: np.ndarray
    count: np.ndarray
    rank: np.ndarray  # place among the most frequent, from 0; the end is not ranked
    class_logs: np.ndarray  # log10(tokens + words + 1) of each class
    class_tokens: np.ndarray
    tokens: int
    words: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if it isn't there."""
        if not len(self.word):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        return np.where(self.word[at] == hashes, at, -1)


def _level(n: Column) -> Column:
    """Sixteenths of a power of two: fewer than 1100 levels for any count."""
    return F.floor(F.log2(n) * 16).cast("int")


def lexicon(counts: DataFrame, s: Settings) -> tuple[Lexicon, DataFrame]:
    """(lexicon, rest): the counts of the words at the highest levels of frequency, as many levels as stay within
    Settings.frequent words, and the table of the other words."""
    by_level = counts.groupBy(_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()
    least, total = None, 0
    for r in sorted(by_level, key=lambda r: -r["level"]):
        total += r["words"]
        if total > s.frequent:
            break
        least = r["level"]
    frequent = _level(F.col("n")) >= (least if least is not None else 1 << 30)
    known = counts.where(frequent).toPandas()  # at most Settings.frequent rows
    known = known.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    end = word_hash(END)
    order = known["word"].to_numpy()
    rank = np.cumsum(order != end) - 1
    rank[order == end] = 1 << 40
    top = order[(rank < s.single)].tolist()
    sums = counts.where(~F.col("word").isin(*top, end) if top else F.col("word") != end).groupBy("ending").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    sizes, shares = np.ones(s.classes), np.zeros(s.classes)
    for r in sums:
        sizes[r["ending"]] += r["n"] + r["v"]
        shares[r["ending"]] += r["n"]
    for i, w in enumerate(order.tolist()):
        if w == end or rank[i] < s.single:
            sizes[0 if w == end else 1 + rank[i]] += known["n"][i] + 1
            shares[0 if w == end else 1 + rank[i]] += known["n"][i]
    by_hash = np.argsort(order)
    lex = Lexicon(order[by_hash], known["n"].to_numpy()[by_hash], rank[by_hash], np.log10(sizes), shares,
                  sum(r["tokens"] for r in by_level), sum(r["words"] for r in by_level))
    return lex, counts.where(~frequent)


# --- model ---------------------------------------------------------------------


def encode(t: Tokens, lex: Lexicon, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, features, place, hashes): each token's class and FEATURES weight rows; of each distinct word, its place
    in the lexicon (-1 if it is not there) and its hash."""
    hashes = hashed(t, s).hashes
    place = lex.find(hashes)
    rank = np.where(place >= 0, lex.rank[place] if len(lex.rank) else 0, 1 << 40)
    own = np.where(rank < s.single, 1 + rank, t.own)
    name = np.where(rank < s.named, rank, s.named + own)[t.code].astype(np.uint64)
    at = np.arange(len(t.code)) - np.repeat(t.starts[:-1], np.diff(t.starts))
    begin = np.uint64(s.named + s.classes)

    def back(k: int) -> np.ndarray:
        out = np.full(len(name), begin, dtype=np.uint64)
        out[k:] = name[:-k]
        out[at < k] = begin
        return out

    one, two, three = back(1), back(2), back(3)
    wide = np.uint64(s.named + s.classes + 1)
    features = np.stack([_row(x, k, s) for k, x in enumerate((one, one * wide + two, two, three))], axis=1)
    return own[t.code], features, place, hashes


def _row(x: np.ndarray, kind: int, s: Settings) -> np.ndarray:
    mixed = (x * np.uint64(FEATURES) + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - s.rows_log2)).astype(np.uint16)


def _sums(features: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The classes' sums of weights less the largest, tokens x classes."""
    z = weights[features[:, 0]]
    z += bias
    for k in range(1, FEATURES):
        z += weights[features[:, k]]
    z -= z.max(axis=1, keepdims=True)
    return z


def class_logs(features: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural log of each class's probability, tokens x classes."""
    z = _sums(features, weights, bias)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def own_logs(classes: np.ndarray, features: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token's own class."""
    z = _sums(features, weights, bias)
    own = z[np.arange(len(classes)), classes]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def descend(classes: np.ndarray, features: np.ndarray, weights: np.ndarray, bias: np.ndarray, used: np.ndarray, s: Settings) -> None:
    """Gradient steps over the tokens, in place. A weight row moves by its mean gradient in the batch, damped where it has
    few tokens; ``used`` counts the tokens of each row."""
    for a in range(0, len(classes), s.batch):
        y, x = classes[a : a + s.batch], features[a : a + s.batch]
        g = _sums(x, weights, bias)
        np.exp(g, out=g)
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        bias -= s.step * g.mean(axis=0)
        for k in range(FEATURES):
            order = np.argsort(x[:, k], kind="stable")
            rows = x[order, k]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            n = np.diff(np.append(first, len(rows)))
            at, total = rows[first], g[order[first]]
            many = np.flatnonzero(n > 1)
            if len(many):  # most trigram rows have one token in a batch
                taken = np.repeat(n > 1, n)
                total[many] = np.add.reduceat(g[order[taken]], np.cumsum(n[many]) - n[many], axis=0)
            total *= (s.step / (n + s.damping)).astype(np.float32)[:, None]
            weights[at] -= total
            used[at] += n


def train(runs: DataFrame, lex: Lexicon, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) after Settings.rounds rounds over ``runs``, by part: 0..rounds-1."""
    sc = runs.sparkSession.sparkContext
    known = sc.broadcast(lex)
    weights = np.zeros((s.rows, s.classes), dtype=np.float32)
    bias = np.log((lex.class_tokens + 1) / (lex.class_tokens + 1).sum()).astype(np.float32)  # the classes' shares to begin with
    for number in range(s.rounds):
        model = sc.broadcast((weights, bias))  # of fixed size

        def run(batches, model=model):
            w, b = (x.copy() for x in model.value)
            used, tokens = np.zeros(s.rows, dtype=np.int64), 0
            for batch in batches:
                for t in read_runs(batch):
                    classes, features, _, _ = encode(t, known.value, s)
                    descend(classes, features, w, b, used, s)
                    tokens += len(classes)
            if not tokens:
                return
            # changes times counts: their sums over the tasks give means by feature
            w = (w - model.value[0]) * used[:, None].astype(np.float32)
            out = {"block": [-1], "change": [((b - model.value[1]) * np.float32(tokens)).tobytes()], "used": [np.array([tokens]).tobytes()]}
            for k in range(0, s.rows, _BLOCK):
                if used[k : k + _BLOCK].any():
                    out["block"].append(k)
                    out["change"].append(w[k : k + _BLOCK].tobytes())
                    out["used"].append(used[k : k + _BLOCK].tobytes())
            yield pa.RecordBatch.from_pydict({"block": pa.array(out["block"], pa.int32()), "change": pa.array(out["change"], pa.binary()),
                                              "used": pa.array(out["used"], pa.binary())})

        parts = runs.where(F.col("part") == number).select("sizes", "codes", "hashes", "own").mapInArrow(run, "block int, change binary, used binary")
        sums = parts.repartition("block").mapInArrow(_sum_blocks, "block int, change binary, used binary").collect()  # one model
        weights, bias = weights.copy(), bias.copy()
        for r in sums:
            change, used = np.frombuffer(r["change"], dtype=np.float64), np.frombuffer(r["used"], dtype=np.int64)
            if r["block"] < 0:
                bias += (change / used[0]).astype(np.float32)
            else:
                at = slice(r["block"], r["block"] + _BLOCK)
                weights[at] += (change.reshape(-1, s.classes) / np.maximum(used, 1)[:, None]).astype(np.float32)
        model.unpersist()
    return weights, bias


def _sum_blocks(batches):
    """Sums of each block's changes and counts over the tasks, read one after another."""
    sums: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for block, change, used in zip(*(b.column(c).to_pylist() for c in ("block", "change", "used"))):
            change, used = np.frombuffer(change, dtype=np.float32), np.frombuffer(used, dtype=np.int64)
            if block not in sums:
                sums[block] = [np.zeros(len(change)), np.zeros(len(used), dtype=np.int64)]
            sums[block][0] += change
            sums[block][1] += used
    yield pa.RecordBatch.from_pydict({
        "block": pa.array(list(sums), pa.int32()), "change": pa.array([x[0].tobytes() for x in sums.values()], pa.binary()),
        "used": pa.array([x[1].tobytes() for x in sums.values()], pa.binary())})


# --- scores --------------------------------------------------------------------


def score_texts(runs: DataFrame, lex: Lexicon, weights: np.ndarray, bias: np.ndarray, s: Settings) -> DataFrame:
    """(row, n_tokens, n_known, logs, class_logs, rare, times) per text of the ``runs``: logs sums
    log10(count + 1) and n_known counts over the tokens in the lexicon; rare lists the other words' hashes with times."""
    model = runs.sparkSession.sparkContext.broadcast((lex, weights, bias))  # of fixed size

    def run(batches):
        lex, weights, bias = model.value
        for b in batches:
            for t, row in zip(read_runs(b), b.column("rows")):
                classes, features, place, hashes = encode(t, lex, s)
                p = np.zeros(len(classes))
                for a in range(0, len(classes), s.batch):
                    y = classes[a : a + s.batch]
                    p[a : a + s.batch] = own_logs(y, features[a : a + s.batch], weights, bias) / np.log(10)
                p -= lex.class_logs[classes]
                known = place[t.code] >= 0
                count = np.where(place >= 0, lex.count[place] if len(lex.count) else 0, 0)
                logs = np.where(known, np.log10(count + 1.0)[t.code], 0.0)
                owner = np.repeat(np.arange(len(t.starts) - 1), np.diff(t.starts))
                pairs = owner[~known] * np.int64(len(hashes)) + t.code[~known]
                pairs, times = np.unique(pairs, return_counts=True)
                at = np.searchsorted(pairs // len(hashes), np.arange(len(t.starts)))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(np.frombuffer(row.as_buffer(), dtype=np.int64)), "n_tokens": pa.array(np.diff(t.starts), pa.int64()),
                    "n_known": pa.array(np.add.reduceat(known.astype(np.int64), t.starts[:-1]), pa.int64()),
                    "logs": pa.array(np.add.reduceat(logs, t.starts[:-1])), "class_logs": pa.array(np.add.reduceat(p, t.starts[:-1])),
                    "rare": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes[pairs % len(hashes)], pa.int64())),
                    "times": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(times, pa.int64()))})

    return runs.drop("part").mapInArrow(
        run, "row long, n_tokens long, n_known long, logs double, class_logs double, rare array<long>, times array<long>")


def held_out(id_col: Column) -> Column:
    """CRC-32 of the id as text, modulo 7, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; every text has an end token, so a null or empty
    text is one token. The rows that are not held out are the training texts. n_known: tokens that occur in them. With c
    a token's training count, N their tokens and V their distinct tokens, base_score sums log10((c + 1) / (N + V + 1)).
    score: log10 probability of the text under the model. Rows equal in id and text train as often as they are there and
    get the same scores. Without training texts all words are unknown. Empty tables give an empty result. Other columns
    are not read.
    """
    s = settings
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), row_key(docs, id_col, text_col).alias("row"),
                       F.col(text_col).alias("text"))
    part = F.when(F.col("held_out"), F.lit(-1)).otherwise(F.pmod("row", F.lit(s.rounds)).cast("int"))
    runs = stored(token_runs(rows.withColumn("part", part), s))
    training = runs.where("part >= 0")
    counts = stored(run_counts(training))
    lex, rest = lexicon(counts, s)
    weights, bias = train(training, lex, s)
    scored = stored(score_texts(runs, lex, weights, bias, s))
    once = scored.dropDuplicates(["row"])  # repeated rows have the same tokens
    rare = once.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    joined = rare.join(rest.select("word", "n"), "word")
    sums = joined.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    each = once.drop("rare", "times").join(sums, "row", "left").select(
        "row", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(lex.tokens + lex.words + 1)))).alias("base_score"),
        (logs + F.col("class_logs")).alias("score"))
    return rows.select("id", "held_out", "row").join(each, "row").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
