"""Near-equal embeddings by NN-descent.

Every vector keeps a list of its nearest known ones. Lists start from blocks of vectors
that fall on the same side of random hyperplanes; a block of too many is split by the
nearest of vectors drawn from it until it fits. Lists are refined: two vectors in the
neighbourhood of a third are compared, and enter each other's lists if they are
nearer than what is there. A list is a guide for the search and may be full; links are
kept apart from it: wherever vectors are compared, a vector's links found there are all
kept, or, where they are more than a list holds, enough of them that all they join
stays joined. Such a vector is saturated and is compared with its whole component, in
blocks, so its links are counted whatever their number. A sample of vectors is audited
against all others; while too many of a vector's links are missing, lists of twice the
size are refined from new hyperplanes, and in the end all vectors are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.llm.common import lowest
from lexmesh.llm.components import components
from lexmesh.session import written

_BLOCK = 512
#: A block of more than _BLOCK vectors is split by so many of its vectors, up to so many times; what is still larger is compared whole.
_PIVOTS, _SPLITS = 8, 12
#: Single precision tells a link from what is none only outside this distance of the threshold.
_BAND = 1e-4
Group = Callable[[dict[str, np.ndarray]], "tuple[np.ndarray, ...] | None"]


def _unit(rows: list) -> list[bytes | None]:
    """Vectors of length one in double precision; None for those without a direction."""
    out: list[bytes | None] = []
    for row in rows:
        v = None if not row or any(x is None for x in row) else np.array(row, np.float64)
        if v is None or not np.isfinite(v).all() or not v.any():
            out.append(None)
            continue
        v = v / np.abs(v).max()  # so that the squares neither overflow nor vanish
        out.append((v / np.sqrt(v @ v) + 0.0).tobytes())
    return out


def units(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(_unit(batch.column("v").to_pylist()), pa.binary())], ["key", "unit"])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(make, "key long, unit binary")


def _matrix(column: pa.Array | np.ndarray, kind: type = np.float64) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _by_group(rows: DataFrame, group: str, schema: str, handle: Group, most: int, order: str = "node") -> DataFrame:
    """Apply ``handle`` to the rows of each group. Groups hold up to ``most`` rows; one of more would be handled in consecutive parts."""
    names = rows.columns
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], fields)

        def part(columns: list[np.ndarray]) -> None:
            found = handle(dict(zip(names, columns)))
            if found is not None and len(found[0]):
                out.append(found)

        for batch in batches:
            now = [np.array(batch.column(n).to_pylist(), object) if pa.types.is_binary(batch.column(n).type) else batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            marks = now[names.index(group)]
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)]
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                for at in range(a, b, most):
                    part([c[at:min(b, at + most)] for c in now])
            last = cuts[-2] if len(cuts) > 1 else 0
            while len(marks) - last > most:
                part([c[last:last + most] for c in now])
                last += most
            held = [c[last:] for c in now]
            if out:
                yield emit()
        if held is not None and len(held[0]):
            part(held)
            if out:
                yield emit()

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, group).sortWithinPartitions(group, order).mapInArrow(run, schema)


def _seeds(nodes: DataFrame, bits: int, tables: int, seed: int, best: int, size: int, threshold: float) -> DataFrame:
    """(src, dst, sim): for each table of ``bits`` hyperplanes, a vector's nearest in its block and the links there."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(u) for u in batch.column("unit").to_pylist()])
            for size in np.unique(sizes):  # vectors of another dimension are never compared
                some = batch.filter(pa.array(sizes == size))
                m = _matrix(some.column("unit")).astype(np.float32)
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, int(size)]).standard_normal((m.shape[1], bits)).astype(np.float32)
                    side = (m @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    place = (np.int64(size) << 44) ^ (np.int64(t) << 36) ^ side
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place), some.column("node"), pa.array([r.tobytes() for r in m], pa.binary())], ["block", "node", "unit"])

    def compare(g: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        return _nearest(g["node"], _matrix(g["unit"], np.float32), best, None, size, threshold)

    dealt = written(nodes.mapInArrow(deal, "block long, node long, unit binary"))
    return _by_group(_fitted(dealt, seed), "block", "src long, dst long, sim float", compare, 8 * _BLOCK)


def _fitted(dealt: DataFrame, seed: int, splits: int = _SPLITS) -> DataFrame:
    """(block, node, unit): blocks of more than _BLOCK rows are split, or dealt into cells if that does not make them fit."""
    out: DataFrame | None = None
    for level in range(splits + 1):
        sizes = written(dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _BLOCK))
        if not sizes.limit(1).count():
            return dealt if out is None else out.unionByName(dealt)
        small = dealt.join(sizes, "block", "left_anti")
        out = small if out is None else out.unionByName(small)
        large = dealt.join(sizes, "block")
        if level == splits:
            return out.unionByName(_cells(large))
        dealt = written(_split(large, [seed, level]))
    raise AssertionError


def _split(large: DataFrame, seed: list[int]) -> DataFrame:
    """Rows go to a block for the pivot nearest to them; pivots are vectors of the block, other ones for each table, pass and level."""
    pivots = large.groupBy("block").agg(F.array(*(
        F.min_by("unit", F.xxhash64("node", "block", *map(F.lit, [*seed, k]))) for k in range(_PIVOTS))).alias("pivots"))
    rows = large.select("block", "node", "unit").join(written(pivots), "block")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            side = np.zeros(batch.num_rows, np.int64)
            units, pivot = batch.column("unit").to_pylist(), batch.column("pivots")
            for block in np.unique(blocks):
                some = np.flatnonzero(blocks == block)
                side[some] = (_matrix([units[i] for i in some], np.float32) @ _matrix(pivot[int(some[0])].as_py(), np.float32).T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("node"), batch.column("unit"), pa.array(side)], ["block", "node", "unit", "side"])

    found = rows.mapInArrow(nearest, "block long, node long, unit binary, side long")
    return found.select(F.xxhash64("block", "side").alias("block"), "node", "unit")


def _nearest(node: np.ndarray, m: np.ndarray, best: int, floor: np.ndarray | None, size: int, threshold: float) -> tuple[np.ndarray, ...] | None:
    """(row, other, similarity): for each row the ``best`` others above its own floor, and the links.

    All links of a row are there if they are up to ``size`` and its list is not full of
    links already; for other rows there are as many as keep together what links join.
    """
    if len(node) < 2:
        return None
    sims = m @ m.T
    np.fill_diagonal(sims, -2)
    floor = np.full(len(node), -1.5, np.float32) if floor is None else floor
    pairs = [_top(sims, np.arange(len(node)), best, floor)]
    close = sims >= threshold - _BAND
    degree = close.sum(axis=1)
    if degree.any():
        full = floor >= threshold + _BAND
        pairs.append(_top(sims, np.flatnonzero((degree > 0) & ~full), size, np.full(len(node), threshold - _BAND - 1e-7)))
        if ((degree > size) | full & (degree > 0)).any():
            pairs += _forest(close, sims >= threshold + _BAND)
    both = np.unique(np.concatenate([a * len(node) + b for a, b in pairs]))
    a, b = both // len(node), both % len(node)
    return node[a], node[b], sims[a, b]


def _top(sims: np.ndarray, rows: np.ndarray, best: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``best`` columns of some rows, above each row's floor."""
    best = min(best, len(sims) - 1)
    top = np.argpartition(-sims[rows], best - 1, axis=1)[:, :best]
    a, b = np.repeat(rows, best), top.ravel()
    kept = sims[a, b] > floor[a]
    return a[kept], b[kept]


def _forest(close: np.ndarray, sure: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that join all that ``close`` pairs join, whichever of those that are not ``sure`` turn out to be links."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    label = np.arange(len(sure))
    left = sure.any(axis=1)
    while left.any():
        edge = np.array([sure.sum(axis=1, where=left[:, None]).argmax()])
        start = edge[0]
        left[start] = False
        while len(edge):
            reached = np.flatnonzero(sure[edge].any(axis=0) & left)
            if len(reached):
                out.append((edge[sure[np.ix_(edge, reached)].argmax(axis=0)], reached))
                label[reached] = start
                left[reached] = False
            edge = reached
    out.append(np.nonzero(np.triu(close & ~sure & (label[:, None] != label[None, :]))))
    return out


def _lists(edges: DataFrame, size: int) -> DataFrame:
    """The ``size`` nearest of each src."""
    pairs = edges.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return written(pairs.withColumn("rank", rank).where(F.col("rank") <= size).select("src", "dst", "sim"))


def _refined(nodes: DataFrame, lists: DataFrame, size: int, threshold: float) -> DataFrame:
    """(src, dst, sim) of one round: all pairs within each neighbourhood are compared; those that are better than the lists, and the links."""
    rank = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("sim"), "src"))
    back = lists.withColumn("rank", rank).where(F.col("rank") <= size).select(F.col("dst").alias("hub"), F.col("src").alias("node"))
    around = lists.select(F.col("src").alias("hub"), F.col("dst").alias("node")).unionByName(back).distinct()
    floors = lists.groupBy("src").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("n"))
    known = nodes.select("node", "unit32").join(floors.withColumnRenamed("src", "node"), "node", "left").select(
        "node", "unit32", F.when(F.col("n") >= size, F.col("least")).otherwise(F.lit(-1.5)).cast("float").alias("floor"))
    rows = around.join(written(known), "node").select("hub", "node", "unit32", "floor")

    def compare(g: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        sizes = np.array([len(u) for u in g["unit32"]])
        same = sizes == sizes[0]
        return _nearest(g["node"][same], _matrix(g["unit32"][same], np.float32), 3, g["floor"][same], size, threshold)

    return _by_group(rows, "hub", "src long, dst long, sim float", compare, _BLOCK)


def _all_pairs(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """(src, dst, sim): the links between all vectors of a dimension, compared in a grid of cells. The work grows with the square of their number."""
    length = F.octet_length("unit32").cast("long")
    sizes = nodes.groupBy(length.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.select(length.alias("block"), "node", F.col("unit32").alias("unit")).join(written(sizes), "block")

    def compare(g: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        return _nearest(g["node"], _matrix(g["unit"], np.float32), 1, None, size, threshold)

    return _by_group(_cells(rows), "block", "src long, dst long, sim float", compare, 8 * _BLOCK)


def _cells(rows: DataFrame) -> DataFrame:
    """(block, node, unit) from (block, n, node, unit): a block of ``n`` rows becomes cells of two parts of _BLOCK rows each, so that every two rows meet."""
    parts = F.ceil(F.col("n") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    spread = rows.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.select(F.xxhash64("block", F.least("own", "k"), F.greatest("own", "k")).alias("block"), "node", "unit")


def _exact(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Each undirected pair once with its cosine in double precision, if that reaches the threshold."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.array([np.frombuffer(a) @ np.frombuffer(b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())])
            kept = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(kept), batch.column("v").filter(kept)], ["u", "v"])

    near = edges.where(F.col("sim") >= threshold - _BAND).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    sides = near.join(nodes.select(F.col("node").alias("u"), F.col("unit").alias("a")), "u").join(nodes.select(F.col("node").alias("v"), F.col("unit").alias("b")), "v")
    return written(sides.select("u", "v", "a", "b").mapInArrow(check, "u long, v long"))


def _enlarged(nodes: DataFrame, roots: DataFrame, links: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, links): for components that hold a saturated list, what each member is linked to, counted over the whole component.

    Members are dealt into blocks; a pair of blocks is one cell, which returns a count for
    each of its rows and never the pairs.
    """
    roots = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
    full = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
    dense = full.join(roots.withColumnRenamed("u", "node"), "node").select("root").distinct()
    members = written(roots.withColumnRenamed("u", "node").join(dense, "root").join(nodes.select("node", "unit", "copies"), "node"))
    parts = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.array(
        F.struct(own.alias("i"), k.alias("j"), F.lit(0).alias("side")), F.struct(k.alias("i"), own.alias("j"), F.lit(1).alias("side")))))
    spread = members.join(written(parts), "root").select("root", "node", "unit", "copies", cells.alias("c")).select("root", "node", "unit", "copies", F.explode("c").alias("c"))
    rows = spread.select(F.xxhash64("root", "c.i", "c.j").alias("cell"), "node", "unit", "copies", F.col("c.side").alias("side"))

    def count(g: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        left, right = g["side"] == 0, g["side"] == 1
        if not left.any() or not right.any():
            return None
        a, b = _matrix(g["unit"][left]), _matrix(g["unit"][right])
        near = a @ b.T >= threshold
        near &= g["node"][left][:, None] != g["node"][right][None, :]
        return g["node"][left], near @ g["copies"][right]

    # Blocks are of _BLOCK rows on average; a cell far above twice that would need a very uneven hash.
    return _by_group(rows, "cell", "node long, links long", count, 8 * _BLOCK).groupBy("node").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, counts: DataFrame, threshold: float, sample: int) -> float:
    """The share of its links that a vector has on average, over those of ``sample`` vectors that have links at all, against every vector; 1 if none has."""
    rows = lowest(nodes, "node", sample).orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "unit").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r.unit), []).append((r.node, bytes(r.unit)))
    asked = {k: (np.array([n for n, _ in v]), _matrix(np.array([u for _, u in v], object))) for k, v in by_size.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(u) for u in batch.column("unit").to_pylist()])
            for size in np.unique(sizes):
                if int(size) not in asked:
                    continue
                some = batch.filter(pa.array(sizes == size))
                node, m = asked[int(size)]
                near = m @ _matrix(some.column("unit")).T >= threshold
                near &= node[:, None] != some.column("node").to_numpy()[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near @ some.column("copies").to_numpy())], ["node", "there"])

    there = nodes.select("node", "unit", "copies").mapInArrow(count, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    share = F.least("there", F.coalesce("links", F.lit(0))) / F.col("there")
    mean = there.where(F.col("there") > 0).join(counts, "node", "left").agg(F.avg(share).alias("mean")).first().mean
    return 1.0 if mean is None else mean


def linked(vectors: DataFrame, threshold: float = 0.95, size: int = 8, tables: int = 10, rounds: int = 3, target: float = 0.98,
           passes: int = 3, audited: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for each row; links are pairs of cosine >= ``threshold`` in double precision.

    Vectors of the same direction are one node with a number of copies, so copies are
    never paired. Vectors that are null, empty, zero or hold null or non-finite parts link
    with nothing; vectors of different dimension are not compared. A row with a null
    key is counted as no one's link and is its own null component. Of repeated rows each is a vector of its own.
    Extra columns are ignored, an empty table gives an empty one.
    """
    rows = written(units(vectors, key, vector))
    nodes = written(rows.where(F.col("unit").isNotNull() & F.col("key").isNotNull()).groupBy("unit").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies")))
    nodes = _with_single(nodes)
    count = nodes.count()
    bits = max(0, (max(count, 1) // 128).bit_length())
    lists = near = None
    for attempt in range(passes + 1):
        whole = attempt == passes
        if whole:
            found = written(_all_pairs(nodes, size, threshold))
        else:
            found = written(_seeds(nodes.select("node", "unit"), bits, tables, attempt, 3, size << attempt, threshold))
            lists = _lists(found if lists is None else lists.unionByName(found), size << attempt)
        near = found if near is None else near.unionByName(found)
        mark = None
        for _ in range(0 if whole else rounds):
            found = written(_refined(nodes, lists, size << attempt, threshold))
            near = near.unionByName(found)
            lists = _lists(lists.unionByName(found), size << attempt)
            now = lists.agg(F.count(F.lit(1)).alias("n"), F.sum("sim").alias("s")).first()
            if mark is not None and now.n == mark.n and abs((now.s or 0) - (mark.s or 0)) <= 1e-4 * max(now.n, 1):
                break
            mark = now
        links = _exact(near, nodes, threshold)
        roots = written(components(links))
        found = _counts(nodes, links, roots, size, threshold)
        if whole or _audit(nodes, found, threshold, audited) >= target:
            break
    named = nodes.select("unit", "node", "copies").join(roots.withColumnRenamed("u", "node"), "node", "left").join(found, "node", "left").select(
        "unit", F.coalesce("root", "node").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    whole = rows.join(written(named), "unit", "left")
    no_one = F.col("key").isNull() | F.col("component_id").isNull()
    return whole.select(
        F.col("key").alias(key), F.when(no_one, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(no_one, F.col("key")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _with_single(nodes: DataFrame) -> DataFrame:
    """The nodes with their vectors in single precision too, which is what neighbourhoods are searched with."""
    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = pa.array([np.frombuffer(u).astype(np.float32).tobytes() for u in batch.column("unit").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, small], [*batch.schema.names, "unit32"])

    return written(nodes.select("node", "unit", "copies").mapInArrow(narrow, "node long, unit binary, copies long, unit32 binary"))


def _counts(nodes: DataFrame, links: DataFrame, roots: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, links): copies of the nodes each node is linked to."""
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("other")))
    listed = ends.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("listed"))
    large = _enlarged(nodes, roots, links, size, threshold)
    return written(listed.join(large, "node", "full").select("node", F.coalesce("links", "listed").alias("links")))
