"""Embedding near-dedup by dual traversal of cover trees.

Vectors are scaled to length one, so cosine c means distance sqrt(2 - 2c). They are dealt into tiles
of bounded size, vectors of one region (nearest of PIVOTS directions) together; a region of any size
is split over as many tiles as it needs. Each tile becomes a cover tree: nested levels whose radii
halve from just above the linking distance down to a quarter of it, every node within the radius of its parent's
level, its first child around its own centre, and each keeps its true covering radius. Pairs of
tiles whose balls can hold a pair within the linking distance are traversed from their roots down:
* distance of centres - both radii > linking distance: the pair of nodes is dropped,
* distance of centres + both radii < linking distance: all pairs are links, counted, not listed,
* else the children are paired; pairs of leaves are decided in double precision.
A traversal returns counts of links per vector and a spanning forest of them, never all pairs.

Which tiles meet is found by levels of balls: tiles of GROUP_BYTES together are a group, groups are
bundles, and only the bundles' balls (at most about MAX_BUNDLES) pass through the driver. Pairs of bundles
that can hold a link compare their groups' balls, pairs of groups that can are exchanged. Tiles and groups
are bounded by bytes, so a task holds 2 x GROUP_BYTES, with the trees about twice that, whatever the
number of vectors: of 10^9 with 768 dimensions some 244,000 tiles of 4,096 vectors (25 MB), 49,000 groups,
4,096 bundles of 12 groups and 25 MB of balls on the driver; a task holds 256 MB of vectors.

Identical vectors are one class; a class of n gives n - 1 links to each of its members.

Defined cases
* null, zero or empty vectors and those with null or non-finite components link with nothing.
* vectors of another length link only with vectors of their own length.
* null vec_ids: rows without an id come out with no links and no component, kept is true.
* repeated rows and ids are counted as vectors of their own; they share a component.
* ties at the threshold are links. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join
from .components import components, spanning

THRESHOLD = 0.95
PIVOTS = 64
TILE = 4096
#: Bytes of vectors in a tile at most.
TILE_BYTES = 32 << 20
#: Bytes of the tiles that are exchanged together at most: the more, the fewer copies of each.
GROUP_BYTES = 128 << 20
#: Bundles of groups, about, whose balls pass through the driver.
MAX_BUNDLES = 4096
#: Nodes of up to this many vectors are not divided.
LEAF = 32
#: Slack of distances in single precision.
SLACK = 1e-3
#: Candidate centres that are compared with a node's members at once, and pairs that are decided at once.
BATCH = 64
PAIRS = 1 << 16


def levels(reach: float) -> list[float]:
    """Radii of the levels below the root: from the least power of a half beyond ``reach`` to a quarter of it.

    Wider levels would put unrelated vectors of many dimensions together by twos, which prunes nothing.
    """
    out = [1.0]
    while out[0] / 2 > reach:
        out[0] /= 2
    while out[-1] > reach / 4:
        out.append(out[-1] / 2)
    return out


def _least_dot(distance):
    """Unit vectors are within ``distance`` if their dot product is at least this."""
    return 1 - np.minimum(distance, 2) ** 2 / 2


def cover(x: np.ndarray, radius: float) -> list[np.ndarray]:
    """Groups of rows of unit vectors ``x``, each within ``radius`` of its first row, whose first rows lie further apart.

    The first group is that of row 0, so that a node's centre is also the centre of its first child.
    """
    groups, alive = [], np.ones(len(x), dtype=bool)
    least, at = _least_dot(radius), 0
    while at < len(x):
        some = np.flatnonzero(alive[at : at + 16 * BATCH])[:BATCH] + at
        if not len(some):
            at += 16 * BATCH
            continue
        rest = np.flatnonzero(alive)
        near = x[some] @ x[rest].T >= least
        for k, i in enumerate(some):
            if alive[i]:
                mine = rest[near[k] & alive[rest]] if near[k].sum() > 1 else np.array([i])
                alive[mine] = False
                alive[i] = False
                groups.append(np.concatenate([[i], mine[mine != i]]))
        at = int(some[-1]) + 1
    return groups


@dataclass
class Tree:
    """Nodes in order of their levels: members are rows[begin:end] with the centre first, children are nodes first:last."""

    rows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


def build(x: np.ndarray, radii: list[float]) -> Tree:
    """The cover tree of unit vectors in double precision."""
    single = x.astype(np.float32)
    rows = np.arange(len(x))
    begin, end, first, last, depth = [0], [len(x)], [0], [0], [0]
    node = 0
    while node < len(begin):
        lo, hi = begin[node], end[node]
        first[node] = last[node] = len(begin)
        if hi - lo > LEAF and depth[node] < len(radii):
            own = rows[lo:hi]
            groups = cover(single[own], radii[depth[node]])
            rows[lo:hi] = own[np.concatenate(groups)]
            for g in groups:
                for column, value in ((begin, lo), (end, lo + len(g)), (first, 0), (last, 0), (depth, depth[node] + 1)):
                    column.append(value)
                lo += len(g)
            last[node] = len(begin)
        node += 1
    begin, end = np.array(begin), np.array(end)
    radius = np.zeros(len(begin))
    for k in np.flatnonzero(end - begin > 1):
        members = x[rows[begin[k] : end[k]]]
        radius[k] = np.sqrt(((members - members[0]) ** 2).sum(axis=1).max())
    return Tree(rows, begin, end, radius, np.array(first), np.array(last))


def _below(tree: Tree, node: int) -> np.ndarray:
    return np.arange(tree.first[node], tree.last[node]) if tree.last[node] > tree.first[node] else np.array([node])


def _survivors(x, a: Tree, left: np.ndarray, y, b: Tree, right: np.ndarray, reach: float):
    """(index of left, index of right, distance of centres) of the pairs of nodes that can hold a link."""
    ra, rb = a.radius[left], b.radius[right]
    out = []
    for at in range(0, len(left), 512):
        r = ra[at : at + 512]
        dots = x[a.rows[a.begin[left[at : at + 512]]]] @ y[b.rows[b.begin[right]]].T
        # most nodes are single vectors; only the others need a wider look
        mask = dots >= _least_dot(reach + SLACK)
        wide, high = np.flatnonzero(r), np.flatnonzero(rb)
        if len(wide):
            mask[wide] |= dots[wide] >= _least_dot(reach + SLACK + r[wide] + rb.max())[:, None]
        if len(high):
            mask[:, high] |= dots[:, high] >= _least_dot(reach + SLACK + rb[high] + r.max())[None, :]
        i, j = np.nonzero(mask)
        apart = np.sqrt(np.maximum(2 - 2 * dots[i, j].astype(np.float64), 0))
        close = apart - r[i] - rb[j] <= reach + SLACK
        out.append((i[close] + at, j[close], apart[close]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


class Links:
    """Counts of links of two tiles' rows, weighted by class sizes, and a spanning forest of the links."""

    def __init__(self, x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, cosine: float, same: bool):
        self.x, self.y, self.wx, self.wy, self.cosine, self.same = x, y, wx, wy, cosine, same
        self.cx, self.cy = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        self.shift = 0 if same else len(x)
        self.label = np.arange(self.shift + len(y))
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.decided = 0  # pairs of vectors that were decided one by one

    def tree(self, u: np.ndarray, v: np.ndarray) -> None:
        self.held.append((u, v))
        if sum(len(x) for x, _ in self.held) > 4 * PAIRS:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        """The forest so far; links that close a circle are dropped."""
        if self.held:
            u, v = map(np.concatenate, zip(*self.held, strict=True))
            mine = spanning(u.tolist(), (v + self.shift).tolist(), len(self.label), self.label)
            self.kept.append((u[mine], v[mine]))
            self.held = []
        none = np.zeros(0, dtype=np.int64)
        return tuple(map(np.concatenate, zip(*self.kept, strict=True))) if self.kept else (none, none)

    def pairs(self, p: np.ndarray, q: np.ndarray) -> None:
        """Decides pairs of rows, none of which is a row with itself or comes twice."""
        for at in range(0, len(p), PAIRS):
            u, v = p[at : at + PAIRS], q[at : at + PAIRS]
            self.decided += len(u)
            linked = np.einsum("ij,ij->i", self.x[u], self.y[v]) >= self.cosine
            u, v = u[linked], v[linked]
            np.add.at(self.cx, u, self.wy[v])
            np.add.at(self.cy, v, self.wx[u])
            self.tree(u, v)

    def leaves(self, sides: list[tuple[np.ndarray, np.ndarray, bool]]) -> None:
        """Decides the pairs of members of pairs of leaves (p, q, whether both are one node)."""
        small: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for p, q, own in sides:
            if len(p) * len(q) > PAIRS:
                self.block(p, q, own)
                continue
            u, v = np.repeat(p, len(q)), np.tile(q, len(p))
            if own:
                later = np.repeat(np.arange(len(p)), len(q)) < np.tile(np.arange(len(q)), len(p))
                u, v = u[later], v[later]
            small.append((u, v))
            held += len(u)
            if held > PAIRS:
                self.pairs(*map(np.concatenate, zip(*small, strict=True)))
                small, held = [], 0
        if small:
            self.pairs(*map(np.concatenate, zip(*small, strict=True)))

    def block(self, p: np.ndarray, q: np.ndarray, own: bool) -> None:
        """The same for large leaves, as blocks of cosines."""
        step = max(1, PAIRS * 64 // len(q))
        for at in range(0, len(p), step):
            rows = p[at : at + step]
            self.decided += len(rows) * len(q)
            hit = self.x[rows] @ self.y[q].T >= self.cosine
            if own:
                hit &= rows[:, None] != q[None, :]
            self.cx[rows] += hit @ self.wy[q]
            if not own:
                self.cy[q] += self.wx[rows] @ hit
            place = np.arange(at, at + len(rows)) if own else np.arange(len(rows)) + len(q)
            i, j = forest(hit, place, len(q) + (0 if own else len(rows)))
            self.tree(rows[i], q[j])

    def all(self, p: np.ndarray, q: np.ndarray, own: bool) -> None:
        """All pairs are links."""
        self.cx[p] += self.wy[q].sum()
        if own:
            self.cx[p] -= self.wy[p]
        else:
            self.cy[q] += self.wx[p].sum()
        self.tree(np.concatenate([p, np.full(len(q), p[0])]), np.concatenate([np.full(len(p), q[0]), q]))


def link_tiles(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray, cosine: float, same: bool, trees: tuple[Tree, Tree] | None = None):
    """(links of x's rows, of y's, the forest's rows of x, of y, work): see Links.

    ``x`` and ``y`` are unit vectors in double precision; ``same`` if they are one tile. ``work`` holds the
    pairs of centres that were compared, those of them that were pruned, and the pairs of vectors decided.
    """
    links = Links(x, y, wx, wy, cosine, same)
    work = {"centres": 0, "pruned": 0, "decided": 0}
    if len(x) and len(y):
        reach = float(np.sqrt(2 - 2 * cosine))
        a, b = trees or (build(x, levels(reach)), build(y, levels(reach)))
        sx, sy = x.astype(np.float32), y.astype(np.float32)
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            own = same and i == j
            left, right = _below(a, i), _below(b, j)
            at, to, apart = _survivors(sx, a, left, sy, b, right, reach)
            work["centres"] += len(left) * len(right)
            work["pruned"] += len(left) * len(right) - len(at)
            if own:
                once = at <= to
                at, to, apart = at[once], to[once], apart[once]
            at, to = left[at], right[to]
            both = a.radius[at] + b.radius[to]
            one = (a.end[at] - a.begin[at] == 1) & (b.end[to] - b.begin[to] == 1)
            self_ = (at == to) if same else np.zeros(len(at), dtype=bool)
            sure = ~one & (apart * ~self_ + both < reach - SLACK)
            ends = ~one & ~sure & (a.last[at] == a.first[at]) & (b.last[to] == b.first[to])
            single = one & ~self_
            links.pairs(a.rows[a.begin[at[single]]], b.rows[b.begin[to[single]]])
            member = lambda k: (a.rows[a.begin[at[k]] : a.end[at[k]]], b.rows[b.begin[to[k]] : b.end[to[k]]], bool(self_[k]))
            for k in np.flatnonzero(sure):
                links.all(*member(k))
            links.leaves([member(k) for k in np.flatnonzero(ends)])
            more = ~one & ~sure & ~ends
            todo += zip(at[more].tolist(), to[more].tolist(), strict=True)
    if same:
        links.cx += links.cy
    work["decided"] = links.decided
    return links.cx, links.cy, *links.reduce(), work


def forest(hit: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) of a spanning forest of a matrix of links, in rounds of one new link a row.

    ``place``: the vertex of each row among ``size`` vertices, of which the first are the columns.
    """
    label, us, vs = np.arange(size), [], []
    rows = np.flatnonzero(hit.any(axis=1))
    while len(rows):
        new = hit[rows] & (label[place[rows]][:, None] != label[: hit.shape[1]][None, :])
        some = new.any(axis=1)
        rows, new = rows[some], new[some]
        if not len(rows):
            break
        cols = new.argmax(axis=1)
        kept = spanning(label[place[rows]].tolist(), label[cols].tolist(), size, label)
        us.append(rows[kept])
        vs.append(cols[kept])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


KEY = ["__h1", "__h2"]


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, vector scaled to length one; null if it links with nothing), by lengths."""
    kind = pa.list_(pa.float64())
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        sizes = np.where(ids.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
        for d in np.unique(sizes):
            rows = pa.array(np.flatnonzero(sizes == d))
            own, n = ids.take(rows), len(rows)
            if not d:
                yield pa.RecordBatch.from_arrays([own, pa.nulls(n, kind)], names=["vec_id", "__v"])
                continue
            x = vectors.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, d)
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                unit = x / norm + 0.0  # + 0.0: no negative zero
            good = np.isfinite(x).all(axis=1) & np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
            flat = pa.array(np.where(good[:, None], unit, 0).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d, pa.int32()), flat, mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([own, lists], names=["vec_id", "__v"])


def _units(vectors: DataFrame) -> DataFrame:
    """vec_id, __v (see _scaled), __h1, __h2 (its hash); computed once."""
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    unit = typed.mapInArrow(_scaled, "vec_id long, __v array<double>")
    return cut(unit.withColumns({"__h1": F.xxhash64("__v"), "__h2": F.xxhash64(F.lit(1), "__v")}))


BALL = "dim int, center array<double>, radius double"


def tile_rows(dim: int, most: int = TILE, size: int = TILE_BYTES) -> int:
    """Vectors of ``dim`` numbers in a tile: a fixed number, or what fits into its bytes."""
    return max(1, min(most, size // (8 * max(dim, 1))))


def group_tiles(dims: list[int], tiles: int, most: int = TILE, size: int = TILE_BYTES) -> int:
    """Tiles in a group: as many of the largest as GROUP_BYTES hold, but enough groups to keep tasks busy."""
    largest = max((8 * d * tile_rows(d, most, size) for d in dims), default=1)
    return max(1, min(GROUP_BYTES // max(largest, 1), tiles // 16))


def _enclosing(balls: DataFrame, key: str) -> DataFrame:
    """A ball around all balls (dim, ``key``, center, radius) of each key."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        centers = np.array(pdf["center"].tolist())
        center = centers.mean(axis=0)
        radius = float((np.sqrt(((centers - center) ** 2).sum(axis=1)) + pdf["radius"].to_numpy()).max())
        return pd.DataFrame([{key: pdf[key].iloc[0], "dim": pdf["dim"].iloc[0], "center": center, "radius": radius}])

    return balls.groupBy("dim", key).applyInPandas(one, f"{key} long, {BALL}")


def _meeting(groups: DataFrame, reach: float) -> DataFrame:
    """Pairs (dim, a, b), a <= b, of groups (dim, grp, bundle, center, radius) whose balls are within ``reach``: each with itself too.

    A group is sent to the pairs of its bundle with those bundles that its ball can reach.
    """
    spark = groups.sparkSession
    balls = _enclosing(groups.select("dim", "bundle", "center", "radius"), "bundle").toArrow()  # about MAX_BUNDLES
    numbers, dims, radii = (balls[c].to_numpy() for c in ("bundle", "dim", "radius"))
    known = {}
    for d in np.unique(dims):
        mine = np.flatnonzero(dims == d)
        known[int(d)] = (numbers[mine], np.array(balls["center"].take(pa.array(mine)).to_pylist()), radii[mine])
    shared = spark.sparkContext.broadcast(known)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                own = row.to_pylist()[0]
                numbers, centers, r = shared.value[own["dim"]]
                near = np.sqrt(((centers - np.array(own["center"])) ** 2).sum(axis=1)) - r - own["radius"] <= reach
                for other in sorted({own["bundle"], *numbers[near].tolist()}):
                    pair = f"{min(own['bundle'], other)}-{max(own['bundle'], other)}"
                    yield pa.RecordBatch.from_arrays([pa.array([pair]), *row.columns], names=["pair", *batch.schema.names])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [x for _, x in pdf.groupby("bundle")]
        a, b = sides[0], sides[-1]
        whole = pdf["pair"].iloc[0].split("-")
        if len(sides) == 1 and whole[0] != whole[1]:  # no group of the other bundle comes near
            return pd.DataFrame({"dim": [], "a": [], "b": []}, dtype="int64")
        x, y = (np.array(s["center"].tolist()) for s in (a, b))
        out = []
        for i, (g, r) in enumerate(zip(a["grp"], a["radius"], strict=True)):
            near = np.sqrt(((y - x[i]) ** 2).sum(axis=1)) - r - b["radius"].to_numpy() <= reach
            others = b["grp"].to_numpy()[near | (b["grp"].to_numpy() == g)]
            out.append(pd.DataFrame({"dim": pdf["dim"].iloc[0], "a": np.minimum(others, g), "b": np.maximum(others, g)}))
        return pd.concat(out).drop_duplicates()

    schema = groups.select(F.lit("").alias("pair"), "*").schema
    return cut(groups.mapInArrow(sent, schema).groupBy("dim", "pair").applyInPandas(compare, "dim int, a long, b long"))


BLOB = "tile long, dim int, center array<double>, radius double, ids binary, n binary, x binary, rows binary, nodes binary, radii binary"


def near_duplicates(vectors: DataFrame, cosine: float = THRESHOLD, tile: int = TILE, tile_bytes: int = TILE_BYTES, bundles: int = MAX_BUNDLES) -> DataFrame:
    """One row per vector of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    units = _units(vectors)
    grouped = units.filter("__v is not null").groupBy(*KEY).agg(F.min("vec_id").alias("__class"), F.count("*").alias("__n"), F.first("__v").alias("__v"))
    classes = cut(grouped.withColumn("__dim", F.size("__v")))
    # regions: the nearest of a few directions, which are the classes of smallest key
    seeds = classes.orderBy(*KEY).limit(PIVOTS).select("__v").collect()
    by_length: dict[int, list] = {}
    for r in seeds:
        by_length.setdefault(len(r["__v"]), []).append(r["__v"])
    held = {n: np.array(v) for n, v in by_length.items()}

    @F.pandas_udf("int")
    def region(v: pd.Series) -> pd.Series:
        sizes = v.map(len).to_numpy()
        out = np.zeros(len(v), dtype=np.int32)
        for n in np.unique(sizes):
            if n in held:
                mine = np.flatnonzero(sizes == n)
                out[mine] = np.argmax(np.stack(v.iloc[mine].tolist()) @ held[n].T, axis=1)
        return pd.Series(out)

    placed = classes.withColumn("__region", region("__v"))
    sizes = placed.groupBy("__region", "__dim").count().collect()  # at most PIVOTS rows a length
    # a region of any size is cut into parts; small ones of a length share a tile
    cells, last = [], {}
    for r in sorted(sizes, key=lambda r: (r["__dim"], r["__region"])):
        most = tile_rows(r["__dim"], tile, tile_bytes)
        parts = -(-r["count"] // most)
        number, room = last.get(r["__dim"], (None, 0))
        if parts == 1 and room >= r["count"]:
            cells.append((r["__region"], r["__dim"], 1, number))
            last[r["__dim"]] = (number, room - r["count"])
        else:
            number = sum(c[2] for c in cells)
            cells.append((r["__region"], r["__dim"], parts, number))
            last[r["__dim"]] = (number, most - r["count"] if parts == 1 else 0)
    table = spark.createDataFrame(cells, "__region int, __dim int, __parts long, __first long")
    number = F.col("__first") + F.pmod(F.col("__h2"), F.col("__parts"))
    dealt = placed.join(F.broadcast(table), ["__region", "__dim"]).select(number.alias("tile"), "__class", "__n", "__v")
    reach = float(np.sqrt(2 - 2 * cosine))
    radii = levels(reach)

    def blob(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__class")
        x = np.array(pdf["__v"].tolist(), dtype=np.float64)
        center = x.mean(axis=0)
        tree = build(x, radii)
        nodes = np.stack([tree.begin, tree.end, tree.first, tree.last]).astype(np.int64)
        row = {
            "tile": pdf["tile"].iloc[0], "dim": x.shape[1], "center": center, "radius": float(np.sqrt(((x - center) ** 2).sum(axis=1).max())),
            "ids": pdf["__class"].to_numpy(np.int64).tobytes(), "n": pdf["__n"].to_numpy(np.int64).tobytes(), "x": x.tobytes(),
            "rows": tree.rows.astype(np.int64).tobytes(), "nodes": nodes.tobytes(), "radii": tree.radius.tobytes(),
        }
        return pd.DataFrame([row])

    blobs = cut(dealt.groupBy("tile").applyInPandas(blob, BLOB))
    tiles = sum(c[2] for c in cells)
    group = group_tiles([c[1] for c in cells], tiles, tile, tile_bytes)
    bundle = group * max(1, -(-tiles // (group * bundles)))
    blobs = blobs.withColumn("grp", F.floor(F.col("tile") / group))
    groups = cut(_enclosing(blobs.select("dim", "grp", "center", "radius"), "grp"))
    met = _meeting(groups.withColumn("bundle", F.floor(F.col("grp") * group / bundle)), reach + SLACK)
    # each tile once for every pair of groups that it is needed in
    sides = met.select("dim", F.concat_ws("-", "a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("grp"))

    def traverse(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = []
        for r in pdf.sort_values("tile").to_dict("records"):
            x = np.frombuffer(r["x"], dtype=np.float64).reshape(-1, r["dim"])
            begin, end, first, last = np.frombuffer(r["nodes"], dtype=np.int64).reshape(4, -1)
            tree = Tree(np.frombuffer(r["rows"], dtype=np.int64), begin, end, np.frombuffer(r["radii"]), first, last)
            tiles.append((r, x, np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["n"], dtype=np.int64), tree))
        one, out = pdf["grp"].nunique() == 1, [pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")]
        for i, (ra, xa, ia, na, ta) in enumerate(tiles):
            for rb, xb, ib, nb, tb in tiles[i:]:
                same = ra["tile"] == rb["tile"]
                # tiles of one group meet in that group's own pair
                if (not one and ra["grp"] == rb["grp"]) or np.linalg.norm(np.subtract(ra["center"], rb["center"])) - ra["radius"] - rb["radius"] > reach + SLACK:
                    continue
                cx, cy, u, v, _ = link_tiles(xa, xb, na, nb, cosine, same, (ta, tb))
                for ids, c in ((ia, cx),) if same else ((ia, cx), (ib, cy)):
                    out.append(pd.DataFrame({"u": ids[c > 0], "v": -1, "n": c[c > 0]}))
                out.append(pd.DataFrame({"u": ia[u], "v": ib[v], "n": 0}))
        return pd.concat(out)

    pairs = blobs.join(sides.hint("merge"), ["dim", "grp"])
    found = cut(pairs.groupBy("dim", "pair").applyInPandas(traverse, "u long, v long, n long"))
    links = found.filter("n > 0").groupBy(F.col("u").alias("__class")).agg(F.sum("n").alias("__links"))
    reached = components(found.filter("n = 0").select("u", "v")).withColumnRenamed("u", "__class")
    per_class = classes.select(*KEY, "__class", "__n").join(links, "__class", "left").join(reached, "__class", "left")
    per_class = cut(per_class.select(*KEY, "__n", (F.coalesce("__links", F.lit(0)) + F.col("__n") - 1).alias("n_links"), F.coalesce("component", "__class").alias("component_id")))
    members = units.filter("__v is not null").drop("__v")
    linked = spread_join(members, per_class, KEY, "__n", ["vec_id"]).select("vec_id", "n_links", "component_id")
    rest = units.filter("__v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(rest).withColumn("kept", kept)
