"""Language-model scores of documents, beside a word-count base.

The model is a causal self-attention network over subword ids (``attention``). What it takes from the corpus: the counts of all
subword ids and words of all training documents (they set its symbols, its output biases and the base), and every window of
every training document for its other weights. Texts are made symbols once, for training and scoring. Windows are dealt to units of
bounded size; in each of eight rounds tasks take steps over an eighth of each of their units' windows from common weights, add up
the units' results, and Spark adds and averages those of the tasks. Ids
beyond the 2047 commonest share one symbol and split its probability by their counts, so every text has a probability. Texts
are lower-cased words and an end; each subword is scored once, in overlapping windows of 32 with at least 8 before it.

The base looks every word up among the counts of the corpus. Words that make at least 1 in 2^20 of it, so at most 2^20 words, travel as a
table; all others are joined by word, and as each is rare, no key of that join is hot. Nothing else is broadcast.

Nulls: a null text is empty and scores its end alone; a null doc_id counts as the empty id, which trains. Repeated rows
are scored each. An empty table gives an empty result; without training documents all counts are zero.
"""

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from barwright.llm import attention
from barwright.llm.common import parts, settle
from barwright.llm.subwords import VOCABULARY, WordIds, shared

FOLDS, HELD_OUT = 7, 2
#: Id of the end in the vocabulary, and the number of its ids.
END_ID, IDS = 49_407, 49_408
STRIDE = 24
#: A word with at least this share of all training tokens is frequent.
FREQUENT = 1 << 20
#: Training windows of a unit, which one task works through; rounds after each of which the units' states are averaged.
UNIT, ROUNDS = 1 << 16, 8
#: Units of a task, so that fewer states are shuffled, unless that leaves fewer tasks than these.
SHARED, TASKS = 4, 32
#: Windows and top rate of a training step, and pieces in which states are added.
STEP, RATE, PIECES = 32, 4e-3, 64
#: Windows gathered and scored at a time, and different words counted before they are handed on.
GATHERED, COUNTED = 2560, 200_000
#: Words whose ids a Python worker remembers over its tasks; about as many as a task of 16 MB meets.
REMEMBERED = 400_000


def folded(docs):
    """doc_id, held_out, text as bytes, and a key that tells rows with one doc_id apart."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    return docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))


def words_of(text):
    return (text or b"").lower().split()


def word_counts(training):
    """(word, n) over all training texts; tasks hand on sums, so a frequent word is a few rows."""
    def run(batches):
        seen = Counter()

        def out():
            b = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return b
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(words_of(t))
                if len(seen) > COUNTED:
                    yield out()
        yield out()
    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(words, ends, vocabulary=VOCABULARY):
    """Counts of all subword ids in the training texts, from the counts of words: at most one row per id of the vocabulary."""
    def run(batches):
        known, total = WordIds(vocabulary), np.zeros(IDS, np.int64)
        for b in batches:
            ws = b.column("word").to_pylist()
            known.known.clear()
            known.learn(ws)
            ids = [np.frombuffer(known.known[w], "<u4") for w in ws]
            total += np.bincount(np.concatenate(ids) if ids else [], weights=np.repeat(b.column("n").to_numpy(), [len(i) for i in ids]), minlength=IDS).astype(np.int64)
        at = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])
    out = np.zeros(IDS, np.int64)
    for r in words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    out[END_ID] += ends
    return out


class Symbols:
    """Ids as symbols: the commonest have one each, spread over the classes; the rest share the last."""

    def __init__(self, counts):
        rest = attention.SYMBOLS - 1
        common = [i for i in np.argsort(-counts, kind="stable")[:rest].tolist() if counts[i]]
        if END_ID not in common:
            common = [END_ID] + common[:rest - 1]
        self.of = np.full(IDS, rest, np.int64)
        self.of[common] = np.arange(len(common))
        self.end = int(self.of[END_ID])
        rare = self.of == rest
        self.inside = np.where(rare, np.log10((counts + 1) / (counts[rare].sum() + max(1, rare.sum()))), 0.0)
        self.counts = np.bincount(self.of, weights=counts, minlength=attention.SYMBOLS)


def encoded(docs, of, inside, vocabulary=VOCABULARY):
    """doc_id, text_key, held_out, n_tokens (words and end), n_subwords, inside (log10 probability of rare ids within their symbol) and symbols of rows of ``folded``."""
    of = of.astype("<u2")

    def run(batches):
        known, zstd = shared(vocabulary, remembered=REMEMBERED), pa.Codec("zstd", 1)
        for b in parts(batches):
            texts = [(t or b"").lower() for t in b.column("text").to_pylist()]
            n_sub, rare, kept = [], [], []
            for ids in known.of_texts(texts):
                ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(END_ID))
                n_sub.append(len(ids))
                rare.append(inside[ids].sum())
                kept.append(zstd.compress(of[ids].tobytes(), asbytes=True))
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), b.column("held_out"), pa.array([len(t.split()) + 1 for t in texts], pa.int64()),
                                   pa.array(n_sub, pa.int64()), pa.array(rare, pa.float64()), pa.array(kept, pa.binary())],
                                  ["doc_id", "text_key", "held_out", "n_tokens", "n_subwords", "inside", "symbols"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, held_out boolean, n_tokens long, n_subwords long, inside double, symbols binary")


def symbols_of(batch):
    """The symbols of each text in a batch of ``encoded``."""
    zstd = pa.Codec("zstd")
    for n, s in zip(batch.column("n_subwords").to_pylist(), batch.column("symbols").to_pylist()):
        yield np.frombuffer(zstd.decompress(s, 2 * n, asbytes=True), "<u2")


def cut(symbols, start):
    """Windows of WINDOW + 1 symbols (each a target once but the first, which is the one before) and their count of targets."""
    n, size = len(symbols), attention.WINDOW
    count = -(-n // size)
    padded = np.full(count * size + 1, start, "<u2")
    padded[1:n + 1] = symbols
    w = np.full((count, size + 2), size, "<u2")
    w[:, :size], w[:, size] = padded[:-1].reshape(count, size), padded[size::size]
    w[-1, -1] = n - size * (count - 1)
    return w


def training_windows(training, units, of, end, vocabulary=VOCABULARY):
    """(unit, round, w) with every window of every training row once; w holds windows of WINDOW + 1 symbols and their count of targets.

    Takes rows of ``encoded``, or of ``folded``, which are encoded on the way. A task gets some units, whole.
    Windows are dealt by a draw that depends on a row's place in the table alone, so that repeated rows spread like any others.
    """
    cells, tasks = units * ROUNDS, max(min(units, TASKS), -(-units // SHARED))
    if "symbols" not in training.columns:
        training = encoded(training, of, np.zeros(IDS), vocabulary)

    def run(batches):
        rng = np.random.default_rng([29, TaskContext.get().partitionId()])
        for b in batches:
            w = np.concatenate([np.zeros((0, attention.WINDOW + 2), "<u2"), *(cut(s, end) for s in symbols_of(b))])
            cell = rng.integers(0, cells, len(w))
            order = np.argsort(cell, kind="stable")
            w, cell = w[order], cell[order]
            at, first = np.unique(cell, return_index=True)
            yield pa.record_batch([pa.array(at // ROUNDS, pa.int32()), pa.array(at % ROUNDS, pa.int32()), pa.array([c.tobytes() for c in np.split(w, first[1:])][:len(at)], pa.binary())], ["unit", "round", "w"])
    return training.select("n_subwords", "symbols").mapInArrow(run, "unit int, round int, w binary").repartitionById(tasks, F.expr(f"unit % {tasks}"))


def unit_step(state, w, r):
    """Steps over all of a unit's windows of round ``r``, in place."""
    w = w[np.argsort(w.view(f"V{w.itemsize * w.shape[1]}").ravel(), kind="stable")]  # whatever the order in which rows arrive
    w = w[np.random.default_rng([31, r]).permutation(len(w))].astype(np.int64)
    for i in range(0, len(w), STEP):
        part = w[i:i + STEP]
        m = (np.arange(attention.WINDOW) < part[:, -1:]).astype(np.float32)
        attention.descend(state, part[:, :attention.WINDOW], part[:, 1:-1], m, attention.falling(RATE, state["step"] + 1, (r + i / len(w)) / ROUNDS))


def trained(windows, weights):
    """Weights after one pass over all of ``windows``: in each round the units descend on their own, then their states are averaged by windows.

    A task adds up the states of its units, so that it hands on one.
    """
    state, sc = attention.fresh(weights), windows.sparkSession.sparkContext
    for r in range(ROUNDS):
        sent = sc.broadcast((attention.packed(state), state["step"]))

        def run(batches, r=r, sent=sent):
            units, total, n, step = {}, 0.0, 0, 0
            for b in batches:
                for u, v in zip(b.column("unit").to_pylist(), b.column("w").to_pylist()):
                    units.setdefault(u, []).append(np.frombuffer(v, "<u2").reshape(-1, attention.WINDOW + 2))
            for u in sorted(units):
                w = np.concatenate(units.pop(u))
                s = attention.unpacked(sent.value[0], weights, sent.value[1])
                unit_step(s, w, r)
                total, n, step = total + attention.packed(s).astype(float) * len(w), n + len(w), max(step, s["step"])
            if n:
                v = np.array_split(total.astype("<f4"), PIECES)
                yield pa.record_batch([pa.array(range(PIECES), pa.int32()), pa.array([n] * PIECES, pa.int64()), pa.array([step] * PIECES, pa.int64()), pa.array([x.tobytes() for x in v], pa.binary())], ["piece", "n", "step", "v"])

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, step = 0.0, 0, 0
            for b in batches:
                for v in b.column("v").to_pylist():
                    total = total + np.frombuffer(v, "<f4").astype(float)
                n, step = n + sum(b.column("n").to_pylist()), max(step, *b.column("step").to_pylist(), 0)
            yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([step], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], ["piece", "step", "v"])
        found = windows.where(F.col("round") == r).select("unit", "w").mapInArrow(run, "piece int, n long, step long, v binary")
        found = sorted(found.groupBy("piece").applyInArrow(add, "piece int, step long, v binary").collect())
        if found:
            state = attention.unpacked(np.concatenate([np.frombuffer(x.v, "<f4") for x in found]), weights, found[0].step)
        sent.unpersist()
    return state["p"]


def scores(docs, tables, end):
    """doc_id, text_key, held_out, n_tokens (words and end), n_subwords and score, the log10 probability of each text, of rows of ``encoded``."""
    def run(batches):
        for b in batches:
            score, held, waiting = b.column("inside").to_numpy().copy(), [], 0

            def settle_windows():
                x, y, m, row = (np.concatenate(c) for c in zip(*held))  # noqa: B023
                for i in range(0, len(x), GATHERED):
                    part = attention.log_probs(tables, x[i:i + GATHERED], y[i:i + GATHERED], STRIDE).astype(float)
                    np.add.at(score, row[i:i + GATHERED], (part * m[i:i + GATHERED]).sum(1) / math.log(10))  # noqa: B023
                held.clear()  # noqa: B023
            for i, s in enumerate(symbols_of(b)):
                x, y, m = attention.windows(s, end, STRIDE)
                held.append((x, y, m, np.full(len(x), i)))
                waiting += len(x)
                if waiting >= GATHERED:
                    settle_windows()
                    waiting = 0
            if held:
                settle_windows()
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "text_key", "held_out", "n_tokens", "n_subwords")), pa.array(score)], ["doc_id", "text_key", "held_out", "n_tokens", "n_subwords", "score"])
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, held_out boolean, n_tokens long, n_subwords long, score double")


def base_sums(docs, counts, frequent):
    """(b_id, b_key, known, logs): tokens with a count, and the sum of log10(count + 1), of each text's words.

    A text sends a row with what the table gives, under a key that is no word as it holds blanks, and a row for each of its rare words; all
    look for a count in one join. Rows that share doc_id and text send equal sums, one mark each; the sums are divided by the marks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table = sent.value
        for b in parts(batches):
            doc, key, word, n, logs, mark = [], [], [], array("q"), array("d"), array("q")
            for i, k, t in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("text").to_pylist()):
                known, total, rest = 0, 0.0, []
                for w, c in Counter(words_of(t)).items():
                    f = table.get(w)
                    if f is None:
                        rest.append((w, c))
                    else:
                        known += c
                        total += c * f
                doc += [i] * (1 + len(rest))
                key += [k] * (1 + len(rest))
                word += [f" {i} {k}".encode(), *[w for w, _ in rest]]
                n.append(known)
                n.extend([c for _, c in rest])
                logs.append(total)
                logs.extend([0.0] * len(rest))
                mark.append(1)
                mark.extend([0] * len(rest))
            yield pa.record_batch([pa.array(doc, b.column("doc_id").type), pa.array(key, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64()), pa.array(logs), pa.array(mark, pa.int64())],
                                  ["b_id", "b_key", "b_word", "n", "logs", "mark"])
    rows = docs.select("doc_id", "text_key", "text").mapInArrow(run, f"b_id {kind}, b_key long, b_word binary, n long, logs double, mark long")
    rows = rows.join(counts.select("word", F.col("n").alias("c")), F.col("b_word") == F.col("word"), "left")
    own = F.col("mark") == 1
    n = F.when(own | F.col("c").isNotNull(), F.col("n"))
    logs = F.when(own, F.col("logs")).otherwise(F.col("n") * F.log10(F.col("c") + 1))
    s = rows.groupBy("b_id", "b_key").agg(F.sum(n).alias("n"), F.sum(logs).alias("logs"), F.sum("mark").alias("mark"))
    return s.select("b_id", "b_key", (F.col("n") / F.col("mark")).cast("long").alias("known"), (F.col("logs") / F.col("mark")).alias("logs"))


def fit(docs, vocabulary=VOCABULARY):
    """What scoring needs, from rows of ``folded``: word counts and totals of the training rows, all rows ``encoded``, and the model's tables."""
    training = docs.where("NOT held_out")
    counts = settle(word_counts(training))
    ends = training.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    ids = id_counts(counts, ends, vocabulary)
    symbols = Symbols(ids)
    units = max(1, round((int(ids.sum()) / attention.WINDOW + ends / 2) / UNIT))
    rows = settle(encoded(docs, symbols.of, symbols.inside, vocabulary))
    weights = trained(settle(training_windows(rows.where("NOT held_out"), units, symbols.of, symbols.end)), attention.initial(symbols.counts))
    least = max(1, -(-total // FREQUENT))
    frequent = {bytes(r.word): math.log10(r.n + 1) for r in counts.where(F.col("n") >= least).collect()}
    return {"counts": counts, "ends": ends, "total": total, "distinct": distinct, "rows": rows, "end": symbols.end, "tables": attention.tables(weights), "frequent": frequent}


def scored(docs, model):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all rows of ``folded``."""
    m = model
    out = scores(m["rows"], m["tables"], m["end"])
    sums = base_sums(docs, m["counts"], m["frequent"])
    out = out.join(sums, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_key") == F.col("b_key")), "left")
    known = F.col("known") + (1 if m["ends"] else 0)
    base = F.col("logs") + math.log10(m["ends"] + 1) - F.col("n_tokens") * math.log10(m["total"] + m["distinct"] + 1)
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(m["total"]).cast("long").alias("train_tokens"),
                      base.alias("base_score"), "score", "n_subwords")


def query(spark, sf_dir):
    docs = folded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored(docs, fit(docs))
