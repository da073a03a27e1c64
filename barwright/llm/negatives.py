"""Hard negatives by an inverted multi-index.

Vectors are cut into halves, each with a codebook of its own (k-means over at most SAMPLE rows, chosen by hash); a row lies in the cell
of its two nearest centroids. All rows are indexed. For an anchor a, no row of cell (i, j) scores more than the sum of the half bounds
a1.C1[i] + |a1| R1[i] and a2.C2[j] + |a2| R2[j], R the radius of a half cluster. A heap runs over the two sorted lists of half
bounds (multi-sequence) and visits cells by falling sums; it stops for a window of scores once that is certified: as many rows
as are asked for lie above the next bound, or the bound is below the window. Each round visits cells with a quota of rows, EIGHT times
the last one's, until all windows are certified, so results are exact and recall is 1.

First the nearest rows of the same label are sought, one open window; then, per distinct score of a positive, the rows of other labels
in its window. Anchors of one label and vector are asked once. Of rows with one label and vector only the first POSITIVES + 1 by
vec_id can be among anyone's first, so a vector that a third of all rows share costs a few rows. Cells are cut or joined to blocks of
about BLOCK rows, anchors to chunks of CHUNK; a task scores one chunk against one block.

Nulls: rows with a null label, a null or empty vector, or a null or non-finite component take no part, nor do vectors of another length than most.
A row with a null vec_id is no anchor and comes last among ties. Repeated rows are rows of their own: each is another's positive. Components
count as at most 2^20 after scaling. A positive with a negative score has an empty window. An empty table, one label, or no anchor
give an empty result. Other columns of the table are not read, whatever their names.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from barwright.llm.common import settle, table
from barwright.llm.vectors import common_length, floors, matrix, usable

POSITIVES, NEGATIVES, EVERY = 5, 5, 100
SCALE, MOST = 256, 1 << 20
#: Rows that the codebooks are fitted on at most, rounds of k-means, centroids of a codebook at most.
SAMPLE, ROUNDS, CENTROIDS = 16_384, 8, 256
BLOCK, CHUNK = 4096, 512
#: Rows of cells that an anchor visits in its first round, and how the quota grows.
QUOTA, EIGHT = 4096, 8
NONE = np.iinfo(np.int64).max
OPEN = 1 << 62


def prepared(emb):
    """(rows, width): _row, vec_id, label, v (binary, little-endian ints), key of label and vector; settled."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = usable(emb.where("label IS NOT NULL")).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), floors("embedding", SCALE, MOST).alias("x"))
    width, n = common_length(rows, "x")
    if not n:
        return None, 0

    def run(batches):
        for b in batches:
            m = matrix(b.column("x"), width).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in m], pa.binary())], ["vec_id", "label", "v"])
    rows = rows.where(F.size("x") == width).mapInArrow(run, "vec_id long, label long, v binary")
    key = F.unhex(F.sha2(F.concat(F.encode(F.concat(F.col("label").cast("string"), F.lit(":")), "UTF-8"), F.col("v")), 256))
    return settle(rows.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "label", "v", key.alias("key"))), width


def codebook(m, k, rng):
    """Centroids of the rows of ``m`` by k-means."""
    c = m[rng.choice(len(m), min(k, len(m)), replace=False)].astype(float)
    for _ in range(ROUNDS):
        near = nearest(m, c)[0]
        total = np.zeros_like(c)
        np.add.at(total, near, m)
        count = np.bincount(near, minlength=len(c))
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(m, c):
    """(number of the nearest centroid, distance to it) of each row."""
    square = (m * m).sum(axis=1)[:, None] - 2 * (m @ c.T) + (c * c).sum(axis=1)
    near = square.argmin(axis=1)
    return near, np.sqrt(np.square(m - c[near]).sum(axis=1))


class Cells:
    """Codebooks, radii of their half clusters and where the rows of each cell lie; at most CENTROIDS squared cells whatever the input."""

    def __init__(self, sample, n):
        self.half = sample.shape[1] // 2
        k = max(2, min(CENTROIDS, int(np.ceil(2 * n ** 0.25))))
        rng = np.random.default_rng(11)
        self.books = [codebook(p, k, rng) for p in (sample[:, :self.half], sample[:, self.half:])]

    def of(self, m):
        """(cell, distances to the two centroids) of rows."""
        (i, r1), (j, r2) = nearest(m[:, :self.half], self.books[0]), nearest(m[:, self.half:], self.books[1])
        return i * len(self.books[1]) + j, r1, r2

    def lay_out(self, cells):
        """Takes the radii from (cell, rows, radius, radius) and deals cells to blocks: small ones together, large ones over several."""
        self.radii = [np.full(len(b), -np.inf) for b in self.books]
        self.place, filled, block = {}, 0, 0
        for cell, count, *radii in sorted(cells):
            for h, at in enumerate(divmod(cell, len(self.books[1]))):
                self.radii[h][at] = max(self.radii[h][at], radii[h])
            if filled and filled + count > BLOCK:
                block, filled = block + 1, 0
            many = -(-count // BLOCK)
            self.place[cell] = (block, many, count)
            filled += count
            if many > 1:
                block, filled = block + many, 0

    def bounds(self, a):
        """Half bounds of the anchors ``a`` (rows) over both codebooks; empty half clusters get minus infinity."""
        out = []
        for part, book, radius in zip((a[:, :self.half], a[:, self.half:]), self.books, self.radii):
            norm = np.sqrt((part * part).sum(axis=1))[:, None]
            reach = np.where(np.isfinite(radius), radius, 0.0)
            out.append(np.where(np.isfinite(radius), (part @ book.T + norm * reach) * 1.0 + 1e-6 * (1 + norm * (reach + np.abs(book).max())), -np.inf))
        return out

    def visit(self, u1, u2, above, needed):
        """Cells of one anchor in the order of falling bounds, from the bound ``above`` downwards, as (cell, bound) while ``needed(bound)``."""
        first, second = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
        s1, s2, wide = u1[first], u2[second], len(u2)
        heap, met = [(-(s1[0] + s2[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            bound = -bound
            if bound == -np.inf or not needed(bound):
                return
            if (bound, -i, -j) < above:
                yield int(first[i]) * wide + int(second[j]), (bound, -i, -j)
            for x in ((i + 1, j), (i, j + 1)):
                if x[0] < len(s1) and x[1] < len(s2) and x not in met:
                    met.add(x)
                    heapq.heappush(heap, (-(s1[x[0]] + s2[x[1]]), *x))


def indexed(pool, width):
    """(cells, blocks) over all rows of ``pool``; blocks are settled: (block, cell, vec_id, label, _row, v), each column the bytes of a block's rows."""
    sample = pool.orderBy(F.xxhash64("_row", "key"), "_row").limit(SAMPLE).select("v").toPandas()["v"]
    cells = Cells(np.frombuffer(b"".join(sample), "<i4").reshape(-1, width).astype(float), pool.count())

    def assign(batches):
        for b in batches:
            m = np.frombuffer(b"".join(b.column("v").to_pylist()), "<i4").reshape(-1, width).astype(float)
            for name, x in zip(("cell", "r1", "r2"), cells.of(m)):
                b = b.append_column(name, pa.array(x))
            yield b
    rows = settle(pool.select("_row", "vec_id", "label", "v").mapInArrow(assign, "_row long, vec_id long, label long, v binary, cell long, r1 double, r2 double"))
    cells.lay_out([tuple(r) for r in rows.groupBy("cell").agg(F.count(F.lit(1)), F.max("r1"), F.max("r2")).collect()])
    place = pool.sparkSession.createDataFrame([(c, b, m) for c, (b, m, _) in cells.place.items()], "cell long, first int, many int")
    block = (F.col("first") + F.pmod(F.xxhash64("_row"), F.col("many"))).cast("int")
    names = ["cell", "vec_id", "label", "_row"]

    def pack(group: pa.Table) -> pa.Table:
        bytes_of = lambda c: group[c].combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        return pa.table({"block": group["block"].slice(0, 1), **{c: pa.array([bytes_of(c)], pa.binary()) for c in names}, "v": pa.array([b"".join(group["v"].to_pylist())], pa.binary())})
    rows = rows.join(F.broadcast(place), "cell").select(block.alias("block"), *names, "v")
    return cells, settle(rows.groupBy("block").applyInArrow(pack, "block int, cell binary, vec_id binary, label binary, _row binary, v binary"))


STATE = "chunk long, keys binary, labels binary, v binary, low binary, high binary, worst binary, above binary"
TASKS = "array<struct<block: int, mask: binary>>"
FOUND = "chunk long, anchor int, goal int, score long, vec_id long, _row long, label long"


def ints(blob, *shape):
    return np.frombuffer(blob, "<i8").reshape(*shape)


def chunks(asked, goals):
    """State rows of at most about CHUNK anchors each: ``asked`` (key, label, v, low array<long>, high array<long>), ``goals`` windows at most."""
    n = asked.count()
    parts = max(1, -(-n // CHUNK))

    def pack(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        low, high = np.full((len(rows), goals), OPEN), np.full((len(rows), goals), -OPEN)
        for i, r in enumerate(rows):
            low[i, :len(r["low"])], high[i, :len(r["high"])] = r["low"], r["high"]
        above = np.tile([np.inf, 0, 0], (len(rows), 1))
        blobs = [b"".join(r["key"] for r in rows), np.array([r["label"] for r in rows], "<i8").tobytes(), b"".join(r["v"] for r in rows), low.astype("<i8").tobytes(), high.astype("<i8").tobytes(),
                 np.full((len(rows), goals), -OPEN, "<i8").tobytes(), above.astype("<f8").tobytes()]
        return pa.table([group["chunk"].slice(0, 1), *[pa.array([b], pa.binary()) for b in blobs]], names=["chunk", "keys", "labels", "v", "low", "high", "worst", "above"])
    chunk = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long")
    return asked.select(chunk.alias("chunk"), "key", "label", "v", "low", "high").groupBy("chunk").applyInArrow(pack, STATE)


def plan_visits(cells, width, goals, most, quota):
    """Takes in what was found, then picks the cells that each anchor of a chunk visits in this round."""
    slot = {}
    for cell, (block, many, _) in sorted(cells.place.items()):
        for b in range(block, block + many):
            slot.setdefault(b, []).append(cell)
    order = {b: {c: i for i, c in enumerate(held)} for b, held in slot.items()}

    def plan(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows:
            return state.append_column("tasks", pa.array([], pa.list_(pa.struct([("block", pa.int32()), ("mask", pa.binary())]))))
        row = state.to_pylist()[0]
        a = np.frombuffer(row["v"], "<i4").reshape(-1, width).astype(float)
        low, worst, above = ints(row["low"], -1, goals), ints(row["worst"], -1, goals).copy(), np.frombuffer(row["above"], "<f8").reshape(-1, 3).copy()
        if found.num_rows:
            at, goal, score = (found[c].to_numpy() for c in ("anchor", "goal", "score"))
            cell = at * goals + goal
            full = np.bincount(cell, minlength=worst.size) >= most
            least = np.full(worst.size, NONE)
            np.minimum.at(least, cell, score)
            worst = np.where(full, least, worst.ravel()).reshape(worst.shape)
        live = low < OPEN
        u1, u2 = cells.bounds(a)
        picked = {}
        for i in range(len(a)):
            # a window is certified once the next bound is below it or below the last of its full list
            floor = np.maximum(low[i], worst[i])[live[i]]
            if not len(floor):
                continue
            least, full, rows = int(floor.min()), bool((floor > -OPEN).all()), 0
            for c, mark in cells.visit(u1[i], u2[i], tuple(above[i]), lambda bound: not full or bound >= least):
                if rows >= quota:
                    break
                above[i] = mark
                if c in cells.place:
                    block, many, count = cells.place[c]
                    rows += count
                    for b in range(block, block + many):
                        picked.setdefault(b, []).append((i, order[b][c]))
        tasks = []
        for b, pairs in sorted(picked.items()):
            mask = np.zeros((len(a), len(order[b])), bool)
            mask[tuple(np.array(pairs).T)] = True
            tasks.append({"block": b, "mask": np.packbits(mask).tobytes()})
        row.update(worst=worst.astype("<i8").tobytes(), above=above.tobytes(), tasks=tasks)
        return pa.Table.from_pylist([row], pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("keys", "labels", "v", "low", "high", "worst", "above")], ("tasks", pa.list_(pa.struct([("block", pa.int32()), ("mask", pa.binary())])))]))
    return plan


def score_blocks(width, goals, most, same):
    """The first ``most`` rows of a block for each anchor and window of a chunk, among the cells that the anchor visits."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["v"], "<i4").reshape(-1, width).astype(float)
                b = np.frombuffer(r["v_of"], "<i4").reshape(-1, width).astype(float)
                cell, ids, label, rows = (ints(r[c], -1) for c in ("cell", "vec_id", "label", "_row"))
                held = np.unique(cell)
                mask = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=len(a) * len(held)).astype(bool).reshape(len(a), -1)
                scores = np.rint(a @ b.T).astype(np.int64)
                low, high, worst = (ints(r[c], -1, goals) for c in ("low", "high", "worst"))
                alike = ints(r["labels"], -1)[:, None] == label
                fit = mask[:, np.searchsorted(held, cell)] & (alike if same else ~alike)
                out = []
                for i in np.nonzero(fit.any(axis=1))[0]:
                    for g in np.nonzero(low[i] <= high[i])[0]:
                        at = np.nonzero(fit[i] & (scores[i] >= max(low[i, g], worst[i, g])) & (scores[i] <= high[i, g]))[0]
                        if len(at) > most:
                            at = at[scores[i, at] >= np.partition(scores[i, at], len(at) - most)[len(at) - most]]
                        at = at[np.lexsort((rows[at], ids[at], -scores[i, at]))][:most]
                        out.extend((r["chunk"], i, g, scores[i, x], ids[x], rows[x], label[x]) for x in at)
                if out:
                    cols = [np.array(c) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[3:]]],
                                                     ["chunk", "anchor", "goal", "score", "vec_id", "_row", "label"])
    return run


def search(index, asked, width, goals, most, same):
    """(key, high, score, vec_id, _row): per asked key and window its first ``most`` rows of the same or of other labels, exactly."""
    spark = asked.sparkSession
    state, found, quota = chunks(asked, goals), spark.createDataFrame([], FOUND), QUOTA
    first = Window.partitionBy("chunk", "anchor", "goal").orderBy(F.desc("score"), "vec_id", "_row")
    cells, blocks = index[0], index[1].withColumnRenamed("v", "v_of")
    while True:
        plan = plan_visits(cells, width, goals, most, quota)
        planned = settle(state.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(plan, f"{STATE}, tasks {TASKS}"))
        state = planned.drop("tasks")
        visits = planned.select("chunk", "labels", "v", "low", "high", "worst", F.explode("tasks").alias("t")).select("*", "t.block", "t.mask").drop("t")
        if visits.isEmpty():
            break
        new = visits.join(blocks, "block").mapInArrow(score_blocks(width, goals, most, same), FOUND)
        best = found.unionByName(new).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
        found = settle(best)
        quota *= EIGHT

    def names(state: pa.Table, found: pa.Table) -> pa.Table:
        keys, high = b"", np.zeros((0, goals), np.int64)
        if state.num_rows:
            keys, high = state["keys"][0].as_py(), ints(state["high"][0].as_py(), -1, goals)
        at, goal = found["anchor"].to_numpy(), found["goal"].to_numpy()
        return pa.table({"key": pa.array([keys[32 * i:32 * i + 32] for i in at], pa.binary()), "high": pa.array(high[at, goal] if len(at) else [], pa.int64()),
                         **{c: found[c] for c in ("score", "vec_id", "_row")}})
    out = state.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(names, "key binary, high long, score long, vec_id long, _row long")
    return out.withColumn("vec_id", F.expr(f"nullif(vec_id, {NONE}L)"))


def first_of(row):
    """Order of rows: higher scores, then smaller ids, nulls last."""
    return F.struct((-F.col("score")).alias("down"), F.col("vec_id").isNull().alias("no"), F.col("vec_id").alias("vec_id"), F.col("_row").alias("_row"), *row)


def mine(emb, every=EVERY):
    """Hard negatives of the anchors (vec_id divisible by ``every``): anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = emb.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, width = prepared(emb)
    if rows is None:
        return spark.createDataFrame([], schema)
    anchors = rows.where(F.col("vec_id") % every == 0)
    asked = settle(anchors.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v")))
    if asked.isEmpty():
        return spark.createDataFrame([], schema)
    ties = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last(), "_row")
    index = indexed(settle(rows.withColumn("_n", F.row_number().over(ties)).where(F.col("_n") <= POSITIVES + 1).drop("_n")), width)

    everything = asked.withColumns({"low": F.array(F.lit(-OPEN)), "high": F.array(F.lit(OPEN))})
    positives = settle(search(index, everything, width, 1, POSITIVES + 1, True).groupBy("key").agg(F.array_sort(F.collect_list(first_of([]))).alias("pos")))
    scores = F.sort_array(F.array_distinct(F.filter(F.transform("pos", lambda p: -p["down"]), lambda s: s >= 0)), False)
    wanted = positives.withColumn("high", scores).where(F.size("high") > 0)
    wanted = asked.join(wanted, "key").withColumn("low", F.transform("high", lambda s: s - F.floor(s / 5)))
    hard = search(index, settle(wanted.select("key", "label", "v", "low", "high")), width, POSITIVES + 1, NEGATIVES, False)
    hard = hard.groupBy("key").agg(F.array_sort(F.collect_list(first_of([F.col("high").alias("high")]))).alias("neg"))

    both = positives.join(hard, "key")
    out = anchors.select("key", F.col("_row").alias("_anchor"), F.col("vec_id").alias("anchor_id")).join(both, "key")
    own = F.slice(F.filter("pos", lambda p: p["_row"] != F.col("_anchor")), 1, POSITIVES)
    out = out.select("anchor_id", "neg", F.explode(own).alias("p"))
    out = out.select("anchor_id", "p", F.posexplode(F.filter("neg", lambda x: x["high"] == -F.col("p")["down"])).alias("at", "x"))
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"),
                      (-F.col("p.down")).alias("positive_score"), (-F.col("x.down")).alias("negative_score"))


def query(spark, sf_dir):
    """Hard negatives of every hundredth embedding."""
    return mine(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
  n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
