"""The k most similar vectors of every vector, as a block matrix join over int8 tiles.

1. *Cells.* Centres are learned in tasks, so that their number grows with the rows: sampled rows (int8) meet by their
   nearest pivot, and in each such group a row that is closer than ``LEADER`` to no leader so far leads a cell. What
   would be more than ``CELL_ROWS`` rows (data without clusters, or all close to each other), and what no leader
   gathers, is cut at random members instead. The few rows that are far from every centre so far are learned from again,
   and may lead cells alone. Every row belongs to its nearest centre.
2. *Units.* Small cells are put together, and cells of more than ``unit_rows`` vectors are split, into units of about that
   size. A tile joins a unit with itself (cell by cell), or two units of one split cell.
3. *Tiles.* The product of two int8 blocks gives each cosine with an error bound; a pair survives if its upper bound
   reaches the k-th best lower bound of either side. Survivors are recomputed in double precision and kept in a heap of
   k + 1 for each row. The products of the codes are integers, and exact: below 2^24 a float32 holds every integer, so
   the blocks go through the same matrix product as floats, several times as fast as the integer kernels at hand.
4. *Reach.* Members of a centre lie in shells around it, each between two measured angles. By the triangle inequality a
   vector's angle to the centre bounds its angle to all of a shell. Where that bound reaches the vector's k-th best so
   far, the vector is also sent to the units of the shell's cell, and compared there in double precision.
5. *Merge.* The sorted lists of all tiles are merged by heaps for each vector, and expanded to all rows that hold it.

Accuracy. With ``probes`` None the result is exact: cells decide what is compared first, never what is found. This is
quadratic where vectors have no clusters, as they reach everywhere. With a number, each vector asks that many other cells
at most, the likeliest first, and the bound of step 4 is sharpened: it allows that a vector and a member lie in the same
direction from the centre; here they are aligned at most ``ALIGNED_BY`` times as well as a sample of such pairs is on
average (in few dimensions this changes nothing). The README gives the measured recall.

Defined cases
- A member is an id with ``size`` finite numbers that are not all zero; nulls, other sizes and null ids are no members.
- Repeated rows count once. Equal vectors under several ids are compared once: each has the others as neighbours at
  similarity 1. Only the k + 1 smallest ids of one vector can be among the best, so only these are carried along.
- Similarities are rounded to 12 digits; of equal ones the smaller id comes first. With k or fewer other members all of
  them are neighbours.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from heapq import heappush, heappushpop, merge
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import written

#: Pivots are drawn from this many rows at most; a group of sampled rows has about GROUP_ROWS for each pivot.
PIVOT_ROWS, GROUP_ROWS = 8_192, 2_048
#: Share of the rows that centres are learned from: all of a small table, a quarter of a large one.
LEARN_ROWS, LEARN_SHARE = 16_384, 0.25
#: Centres that come to the driver and are broadcast (24 MB as int8). Beyond them cells grow, and none of their rows is left out.
MOST_CELLS = 32_768
#: Cosine from which a vector belongs to a leader.
LEADER = 0.5
#: How many sampled rows make a cell; a vector that is alone shows nothing about where its neighbours are.
FOLLOWERS = 2
#: Rows that a cell should not exceed, as a sample tells.
CELL_ROWS = 8_192
#: Centres that each row is compared with in full; beyond, only with those of the NEAR_GROUPS nearest groups of centres.
DIRECT, NEAR_GROUPS = 4_096, 8
UNIT_ROWS = 4_096
#: Cosines at which the shells around a centre end, and by how much (in radians) float32 may misjudge two angles.
SHELLS, SLACK = np.array([LEADER, 0.7, 0.8, 0.9]), 0.01
#: Rows that no leader covers are learned from again, so many times at most, and only while they are no larger share.
ROUNDS, STRAY_SHARE = 3, 0.05
#: Rows that show how directions away from a centre are aligned, and by how many times their spread two may be at most.
ALIGNED_ROWS, ALIGNED_BY = 1_024, 16


# --- rows -------------------------------------------------------------------------------------------------------------


def _members(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors (float32) of the members in a batch of (id, vector)."""
    ids, vectors = batch.column(0), batch.column(1)
    offsets, flat = vectors.offsets.to_numpy(), vectors.values
    lengths = np.diff(offsets)
    good = (lengths == size) & vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    if not len(rows):
        return np.empty(0, np.int64), np.empty((0, size), np.float32)
    x = np.stack([values[offsets[i] : offsets[i] + size] for i in rows]).astype(np.float32)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)  # a null inside a vector reads as NaN
    return ids.to_numpy(zero_copy_only=False)[rows[fine]].astype(np.int64), x[fine]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, error norms. As float32 the codes' products are exact up to 1,040 dimensions."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(np.square(unit - codes * scale[:, None]).sum(1))
    return codes.astype(np.int8), scale, error


def _vector_id(row: np.ndarray) -> bytes:
    return blake2b((row + np.float32(0)).tobytes(), digest_size=16).digest()  # + 0 makes -0 and 0 one


# --- cells ------------------------------------------------------------------------------------------------------------


def _lead(sample: np.ndarray, most: float, fewest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, followers and whether each was cut at random, of one group of ``sample`` (unit rows); cells hold ``fewest`` to ``most`` of them."""
    leaders = np.empty((0, sample.shape[1]), np.float32)
    for start in range(0, len(sample), 512):
        part = sample[start : start + 512]
        free = np.ones(len(part), bool)
        if len(leaders):
            free &= (part @ leaders.T).max(1) < LEADER
        near = part @ part.T
        chosen = []
        for i in range(len(part)):
            if free[i]:
                chosen.append(i)
                free &= near[i] < LEADER
        leaders = np.concatenate([leaders, part[chosen]])
    own = np.concatenate([(sample[s : s + 2048] @ leaders.T).argmax(1) for s in range(0, len(sample), 2048)])
    followers = np.bincount(own, minlength=len(leaders))
    large, small = followers > most, followers < fewest
    sums = np.zeros_like(leaders)
    np.add.at(sums, own, sample)
    plain = ~large & ~small
    centres, counts, cut = [sums[plain]], [followers[plain]], [np.zeros(plain.sum(), bool)]
    for rows in [*(np.flatnonzero(own == c) for c in np.flatnonzero(large)), np.flatnonzero(small[own])]:
        if len(rows):
            # rows come in the order of their hash, so the first are as good as any
            at = sample[rows[: int(-(-len(rows) // most))]]
            nearest = (sample[rows] @ at.T).argmax(1)
            centres.append(at)
            counts.append(np.bincount(nearest, minlength=len(at)))
            cut.append(np.ones(len(at), bool))
    return np.concatenate(centres), np.concatenate(counts), np.concatenate(cut)


class Cells:
    """Centres, each of which is a cell of its own, and groups of centres to search them by."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        self.group_of = None
        if len(centres) > DIRECT:
            self.heads = centres[:: int(len(centres) ** 0.5)]
            self.group_of = np.concatenate([(centres[s : s + 2048] @ self.heads.T).argmax(1) for s in range(0, len(centres), 2048)])

    def candidates(self, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, centres) to compare: all with all, or by the groups of centres nearest to each row."""
        if self.group_of is None:
            yield np.arange(len(unit)), np.arange(len(self.centres))
            return
        near = np.argpartition(-(unit @ self.heads.T), NEAR_GROUPS, axis=1)[:, :NEAR_GROUPS]
        for g in np.unique(near):
            yield np.flatnonzero((near == g).any(1)), np.flatnonzero(self.group_of == g)

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centre of each unit row and the cosine to it."""
        unit = unit.astype(np.float32)
        out, cosine = np.zeros(len(unit), np.int64), np.full(len(unit), -2, np.float32)

        def settle(rows: np.ndarray, centres: np.ndarray) -> None:
            for start in range(0, len(rows), 2048):
                r = rows[start : start + 2048]
                cosines = unit[r] @ self.centres[centres].T
                best = cosines.argmax(1)
                top = np.take_along_axis(cosines, best[:, None], 1)[:, 0]
                better = top > cosine[r]
                out[r[better]], cosine[r[better]] = centres[best[better]], top[better]

        for rows, centres in self.candidates(unit):
            settle(rows, centres)
        if self.group_of is not None:
            # where no centre of those groups is near, all are asked
            settle(np.flatnonzero(cosine < LEADER), np.arange(len(self.centres)))
        return out, cosine


def _merged(centres: np.ndarray, followers: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Unit centres, those with the most followers first; of leaders that are close to each other one stays."""
    order = np.lexsort((-followers, cut))
    unit, cut = _unit(centres[order]).astype(np.float32), cut[order]
    kept = np.empty((0, unit.shape[1]), np.float32)
    for start in range(0, len(unit), 1024):
        part, own = unit[start : start + 1024], cut[start : start + 1024]
        free = own | ((part @ kept.T).max(1) < LEADER if len(kept) else np.ones(len(part), bool))
        near = part @ part.T
        for i in range(len(part)):
            if free[i] and not own[i]:
                free[i + 1 :] &= own[i + 1 :] | (near[i, i + 1 :] < LEADER)
        kept = np.concatenate([kept, part[free]])
    return kept[:MOST_CELLS]


def _sampled(rows: DataFrame, size: int, share: float, salt: int, cells) -> DataFrame:
    """About ``share`` of the rows that are far from all centres so far, as int8 codes; the choice depends on ids alone."""

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _members(batch, size)
            unit = _unit(x) if len(x) else x
            if len(x) and len(cells.value.centres):
                far = cells.value.nearest(unit)[1] < LEADER
                ids, unit = ids[far], unit[far]
            codes = _quantised(unit)[0] if len(unit) else ()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])

    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return chosen.mapInArrow(pick, "id long, code binary")


def _of_codes(codes: list[bytes]) -> np.ndarray:
    return _unit(np.stack([np.frombuffer(c, np.int8) for c in codes])).astype(np.float32)


def _learned(rows: DataFrame, size: int, cells, total: int, fewest: int) -> np.ndarray:
    """Centres for about ``total`` rows that are far from those so far; at most MOST_CELLS come to the driver."""
    context = rows.sparkSession.sparkContext
    share = max(min(1.0, LEARN_ROWS / max(1, total)), LEARN_SHARE)
    groups = max(1, int(total * share) // GROUP_ROWS)
    pivots = np.empty((0, size), np.float32)
    if groups > 1:
        first = _sampled(rows, size, min(1.0, 2 * min(groups, PIVOT_ROWS) / total), 1, cells).select("code").limit(min(groups, PIVOT_ROWS)).collect()
        pivots = _of_codes([bytes(r.code) for r in first]) if first else pivots
    shared = context.broadcast(pivots)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).to_pylist()
            nearest = (_of_codes(codes) @ shared.value.T).argmax(1) if codes and len(shared.value) else np.zeros(len(codes), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int64()), batch.column(0), batch.column(1)], names=["pivot", "id", "code"])

    def learn(table: pa.Table) -> pa.Table:
        order = np.argsort([blake2b(i.to_bytes(8, "little", signed=True), digest_size=8).digest() for i in table.column("id").to_pylist()])
        codes = table.column("code").to_pylist()
        centres, followers, cut = _lead(_of_codes([codes[i] for i in order]), max(1.0, CELL_ROWS * share), fewest)
        packed = [c.tobytes() for c in _quantised(_unit(centres))[0]]
        return pa.table({"code": pa.array(packed, pa.binary()), "followers": pa.array(followers, pa.int64()), "cut": pa.array(cut, pa.bool_())})

    # equal codes count once; a pivot with many rows is spread over several groups
    placed = _sampled(rows, size, share, 2, cells).mapInArrow(place, "pivot long, id long, code binary").groupBy("pivot", "code").agg(F.min("id").alias("id"))
    if groups > 1:
        placed = written(placed)  # counted, then learned from
        sizes = placed.groupBy(F.col("pivot").alias("of_pivot")).agg(F.count("*").alias("n"))
        part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / (8 * GROUP_ROWS))))
        placed = placed.join(sizes, F.col("pivot") == F.col("of_pivot")).withColumn("part", part).drop("of_pivot", "n")
    else:
        placed = placed.withColumn("part", F.lit(0).cast("long"))
    found = placed.groupBy("pivot", "part").applyInArrow(learn, "code binary, followers long, cut boolean").orderBy("cut", F.desc("followers"), "code").limit(2 * MOST_CELLS).collect()
    if not found:
        return np.empty((0, size), np.float32)
    return _merged(_of_codes([bytes(r.code) for r in found]), np.array([r.followers for r in found]), np.array([r.cut for r in found]))


def fit_cells(rows: DataFrame, size: int) -> tuple:
    """Cells (broadcast; at most MOST_CELLS centres) and the shells of their members."""
    context = rows.sparkSession.sparkContext
    shared, measured, fewest, strays = context.broadcast(Cells(np.empty((0, size), np.float32))), [], FOLLOWERS, rows.count()
    for _ in range(ROUNDS):
        more = _learned(rows, size, shared, strays, fewest)
        if not len(more):
            break
        shared = context.broadcast(Cells(np.concatenate([shared.value.centres, more])[:MOST_CELLS]))
        measured = _shells(rows, size, shared)
        total, strays, fewest = sum(s.n for s in measured), sum(s.n for s in measured if s.shell == 0), 1
        # many strays mean that there are no clusters to find
        if not strays or strays > STRAY_SHARE * total:
            break
    return shared, measured


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _shells(rows: DataFrame, size: int, cells) -> list:
    """(centre, least, greatest angle, n) of the distinct vectors in each shell, n to a few per cent; at most four for each centre come to the driver."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _members(batch, size)
            if len(x):
                centre, cosine = cells.value.nearest(_unit(x))
                columns = [pa.array(centre, pa.int64()), pa.array(np.searchsorted(SHELLS, cosine), pa.int64()), pa.array(_angle(cosine).astype(np.float64)), pa.array([_vector_id(r) for r in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["centre", "shell", "angle", "vector_id"])

    measured = rows.mapInArrow(measure, "centre long, shell long, angle double, vector_id binary")
    return measured.groupBy("centre", "shell").agg(F.min("angle").alias("least"), F.max("angle").alias("greatest"), F.approx_count_distinct("vector_id").alias("n")).collect()


class Reach:
    """Shells around centres, and which of them a vector may have neighbours in."""

    def __init__(self, shells: list[tuple[int, float, float]], cells: Cells) -> None:
        self.centre = np.array([c for c, _, _ in shells], np.int64)
        self.least = np.array([a for _, a, _ in shells], np.float32)
        self.greatest = np.array([a for _, _, a in shells], np.float32)
        self.cell = self.centre
        self.used, self.column = np.unique(self.centre, return_inverse=True)
        self.centres = cells.centres[self.used]

    def most_similar(self, unit: np.ndarray, aligned: float = 1.0) -> np.ndarray:
        """For each unit row and shell: the greatest cosine to a member, if both lie aligned by ``aligned`` around the centre."""
        angle = _angle(unit.astype(np.float32) @ self.centres.T)[:, self.column]
        best = np.clip(np.arctan2(aligned * np.sin(angle), np.cos(angle)), self.least, self.greatest)
        return np.cos(angle) * np.cos(best) + aligned * np.sin(angle) * np.sin(best)

    def of(self, unit: np.ndarray, floor: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """For each unit row and shell of another cell: may a member reach the row's ``floor``?"""
        return (self.most_similar(unit) >= np.cos(np.minimum(_angle(floor) + SLACK, np.pi))[:, None]) & (cell[:, None] != self.cell)

    def likeliest(self, unit: np.ndarray, floor: np.ndarray, cell: np.ndarray, most: int | None, aligned: float) -> list[np.ndarray]:
        """For each unit row the cells that it reaches, the ``most`` nearest of them at most."""
        similar = self.most_similar(unit, aligned)
        reached = (similar >= np.cos(np.minimum(_angle(floor) + SLACK, np.pi))[:, None]) & (cell[:, None] != self.cell)
        out = []
        for row, cosines in zip(reached, similar, strict=True):
            at = np.flatnonzero(row)
            by_cosine = self.cell[at[np.argsort(-cosines[at], kind="stable")]]
            _, first = np.unique(by_cosine, return_index=True)
            out.append(by_cosine[np.sort(first)[:most]])
        return out


def _alignment(rows: DataFrame, size: int, cells) -> float:
    """How well a vector and a member of another cell are aligned around that cell's centre at most, by a sample of such pairs."""
    everything = rows.sparkSession.sparkContext.broadcast(Cells(np.empty((0, size), np.float32)))
    sample = _sampled(rows, size, min(1.0, 2 * ALIGNED_ROWS / max(1, rows.count())), 3, everything).select("code").limit(ALIGNED_ROWS).collect()
    if len(sample) < 2:
        return 1.0
    x = _of_codes([bytes(r.code) for r in sample])
    centre, cosine = cells.value.nearest(x)
    to_centre = x @ cells.value.centres[centre].T
    spread = np.sqrt(np.maximum(1 - to_centre**2, 1e-6) * np.maximum(1 - cosine**2, 1e-6)[None, :])
    aligned = (x @ x.T - to_centre * cosine[None, :]) / spread
    others = (centre[:, None] != centre[None, :]) & (cosine < 0.999)[None, :]
    return float(min(1.0, ALIGNED_BY * np.sqrt(np.mean(aligned[others] ** 2)))) if others.any() else 1.0


# --- units and tiles --------------------------------------------------------------------------------------------------


class Layout:
    """Which unit a row belongs to, and which tiles a unit takes part in; its size follows the number of units."""

    def __init__(self, counts: dict[int, int], unit_rows: int) -> None:
        self.first_unit: dict[int, int] = {}  # of a cell
        self.parts: dict[int, int] = {}  # units over which a cell is split
        units, filled = 0, unit_rows
        groups: list[range] = []  # units that hold one split cell
        for cell, n in sorted(counts.items()):
            if n > unit_rows:
                parts = -(-n // unit_rows)
                self.first_unit[cell], self.parts[cell] = units, parts
                groups.append(range(units, units + parts))
                units, filled = units + parts, unit_rows
            else:
                if filled + n > unit_rows:
                    units, filled = units + 1, 0
                self.first_unit[cell], self.parts[cell] = units - 1, 1
                filled += n
        # (left unit, right unit): a unit with itself, or two of one split cell
        self.tiles: list[tuple[int, int]] = [(u, u) for u in range(units)]
        for g in groups:
            self.tiles += [(a, b) for a in g for b in g if a < b]
        self.of_unit: dict[int, list[tuple[int, bool]]] = defaultdict(list)  # (tile, on the right?)
        for t, (left, right) in enumerate(self.tiles):
            self.of_unit[left].append((t, False))
            if right != left:
                self.of_unit[right].append((t, True))

    def units(self, cell: int) -> range:
        """All units of a cell."""
        return range(self.first_unit[cell], self.first_unit[cell] + self.parts[cell])

    def unit(self, cell: int, vector_id: bytes) -> int:
        return self.first_unit[cell] + int.from_bytes(vector_id[:8], "little") % self.parts[cell]


ROWS = "tile int, on_right boolean, cell long, vector_id binary, vector binary, ids array<long>"
HITS = "vector_id binary, hits array<struct<distance:double,id:long>>"
#: What a tile found, and of vectors that reach other cells also the vector, its cell, its k-th best and the units to ask.
FOUND = HITS + ", vector binary, cell long, floor double, units array<int>"
_HITS = pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64())]))


def _send(rows: DataFrame, size: int, k: int, cells, layout) -> DataFrame:
    """Each distinct vector of a batch once for every tile of its unit, with its k + 1 smallest ids."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _members(batch, size)
            if not len(x):
                continue
            same: dict[bytes, list[int]] = defaultdict(list)
            for i, row in enumerate(x):
                same[_vector_id(row)].append(i)
            names = [*same]
            firsts = x[[same[v][0] for v in names]]
            out: list[list] = [[] for _ in range(6)]
            for v, row, cell in zip(names, firsts, cells.value.nearest(_unit(firsts))[0], strict=True):
                smallest = sorted({int(ids[i]) for i in same[v]})[: k + 1]
                for tile, on_right in layout.value.of_unit[layout.value.unit(int(cell), v)]:
                    for column, value in zip(out, (tile, on_right, int(cell), v, row.tobytes(), smallest), strict=True):
                        column.append(value)
            types = (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(send, ROWS)


def _stored(table: pa.Table, size: int) -> np.ndarray:
    """The vectors of a table; they lie one after the other in a single buffer."""
    column = table.column("vector").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * size, int(first)).reshape(len(column), size) if len(column) else np.empty((0, size), np.float32)


class _Side:
    """The distinct vectors of one side of a tile, ordered by cell; as stored, as int8 codes, and what they found."""

    def __init__(self, table: pa.Table, k: int, size: int) -> None:
        names, cells = table.column("vector_id").to_pylist(), table.column("cell").to_pylist()
        same: dict[tuple[int, bytes], list[int]] = defaultdict(list)
        for i, key in enumerate(zip(cells, names, strict=True)):
            same[key].append(i)
        keys = sorted(same)
        self.names, self.cells = [v for _, v in keys], np.array([c for c, _ in keys], np.int64)
        ids = table.column("ids").to_pylist()
        self.ids = [sorted({x for i in same[key] for x in ids[i]})[: k + 1] for key in keys]
        stored = _stored(table, size)
        self.stored = stored[[same[key][0] for key in keys]] if keys else stored
        self.codes = np.empty((len(keys), size), np.int8)
        self.scale, self.error = np.empty(len(keys)), np.empty(len(keys))
        for start in range(0, len(keys), 512):
            part = slice(start, start + 512)
            self.codes[part], self.scale[part], self.error[part] = _quantised(_unit(self.stored[part]))
        self.found: list[list[tuple[float, int]]] = [[] for _ in keys]  # heaps of (cosine, -id), the worst first
        self.floor = np.full(len(keys), -2.0)

    def add(self, own: np.ndarray, other: _Side, theirs: np.ndarray, cosine: np.ndarray, most: int) -> None:
        for i, j, c in zip(own.tolist(), theirs.tolist(), cosine.tolist(), strict=True):
            heap = self.found[i]
            for x in other.ids[j]:
                if len(heap) < most:
                    heappush(heap, (c, -x))
                elif heap[0] < (c, -x):
                    heappushpop(heap, (c, -x))
                else:
                    break  # ids are in order: the others are no better
            if len(heap) == most:
                self.floor[i] = max(self.floor[i], heap[0][0] - 1e-9)


def _compare(a: _Side, rows_a: slice, b: _Side, rows_b: slice, k: int) -> None:
    """Survivors of one product of int8 blocks go to the heaps of both sides; a row with itself counts as similarity 1."""
    same = a is b and rows_a == rows_b
    ea, eb = a.error[rows_a][:, None], b.error[rows_b][None, :]
    # integers, and exact as float32: see the head of this module
    product = a.codes[rows_a].astype(np.float32) @ b.codes[rows_b].astype(np.float32).T
    near = product * (a.scale[rows_a][:, None] * b.scale[rows_b][None, :])
    slack = ea + eb + ea * eb
    low, high = near - slack, near + slack
    need = k + 1  # a row's own ids are among what it finds
    if low.shape[1] > need:
        a.floor[rows_a] = np.maximum(a.floor[rows_a], np.partition(low, -need, axis=1)[:, -need])
    if not same and low.shape[0] > need:
        b.floor[rows_b] = np.maximum(b.floor[rows_b], np.partition(low, -need, axis=0)[-need])
    to_a = high >= a.floor[rows_a][:, None]
    to_b = to_a if same else high >= b.floor[rows_b][None, :]
    i, j = np.nonzero(to_a | to_b)
    cosine = np.empty(len(i))
    ua = _unit(a.stored[rows_a])
    ub = ua if same else _unit(b.stored[rows_b])
    for start in range(0, len(i), 1024):
        part = slice(start, start + 1024)
        cosine[part] = np.einsum("ij,ij->i", ua[i[part]], ub[j[part]])
    cosine = np.clip(np.round(cosine, 12), -1, 1)
    if same:
        cosine[i == j] = 1.0
    for side, other, rows, others, own, theirs, wanted in ((a, b, rows_a, rows_b, i, j, to_a[i, j]), (b, a, rows_b, rows_a, j, i, to_b[i, j])):
        side.add(own[wanted] + rows.start, other, theirs[wanted] + others.start, cosine[wanted], need)
        if same:
            break


def _blocks(start: int, stop: int, step: int) -> list[slice]:
    return [slice(s, min(s + step, stop)) for s in range(start, stop, step)]


def _asked(side: _Side, reach: Reach, layout: Layout, probes: int | None, aligned: float, step: int = 256) -> list[list[int]]:
    """Units of other cells that may hold neighbours of each row."""
    out: list[list[int]] = []
    for part in _blocks(0, len(side.names), step):
        for cells in reach.likeliest(_unit(side.stored[part]), side.floor[part], side.cells[part], probes, aligned):
            out.append(sorted({u for c in cells.tolist() for u in layout.units(c)}))
    return out


def _best(heap: list[tuple[float, int]]) -> list[dict]:
    return [{"distance": -c, "id": -x} for c, x in sorted(heap, reverse=True)]


def _tile(table: pa.Table, reach: Reach, layout: Layout, k: int, size: int, probes: int | None, aligned: float, step: int = 512) -> pa.Table:
    """Best k + 1 of each row of both sides within one tile, and where else to look for those of the left one."""
    unit, other = layout.tiles[table.column("tile")[0].as_py()]
    on_right = table.column("on_right")
    left, right = _Side(table.filter(pc.invert(on_right)), k, size), _Side(table.filter(on_right), k, size)
    if unit == other and left.names:
        ends = [*(np.flatnonzero(np.diff(left.cells)) + 1).tolist(), len(left.names)]
        for start, stop in zip([0, *ends], ends, strict=False):
            blocks = _blocks(start, stop, step)
            for n, x in enumerate(blocks):
                for y in blocks[n:]:
                    _compare(left, x, left, y, k)
    for x in _blocks(0, len(left.names), step):
        for y in _blocks(0, len(right.names), step):
            _compare(left, x, right, y, k)
    names, found, vectors, cells, floors, units = [], [], [], [], [], []
    for side in (left, right):
        names += side.names
        found += [_best(heap) for heap in side.found]
        asked = _asked(side, reach, layout, probes, aligned) if side is left and unit == other and len(reach.centre) else [[]] * len(side.names)
        vectors += [row.tobytes() if u else None for row, u in zip(side.stored, asked, strict=True)]
        cells += side.cells.tolist()
        floors += side.floor.tolist()
        units += [u or None for u in asked]
    columns = (names, found, vectors, cells, floors, units)
    types = (pa.binary(), _HITS, pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.int32()))
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["vector_id", "hits", "vector", "cell", "floor", "units"])


# --- other cells ------------------------------------------------------------------------------------------------------

VISITS = "tile long, asks boolean, vector_id binary, vector binary, cell long, floor double, centre long, cosine float, ids array<long>"
_VISITS = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.float32(), pa.list_(pa.int64()))


def _visits(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _VISITS, strict=True)], names=[c.split()[0] for c in VISITS.split(", ")])


def _part(vector_id: bytes, parts: int) -> int:
    return int.from_bytes(vector_id[8:], "little") % parts


def _visiting(found: DataFrame, parts: dict[int, int], most: int) -> DataFrame:
    """Vectors that reach other cells, once for every unit that they ask."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _VISITS]
            for r in batch.to_pylist():
                for u in r["units"]:
                    for column, value in zip(out, (u * most + _part(r["vector_id"], parts[u]), True, r["vector_id"], r["vector"], r["cell"], r["floor"], None, None, None), strict=True):
                        column.append(value)
                if len(out[0]) >= UNIT_ROWS:
                    yield _visits(out)
                    out = [[] for _ in _VISITS]
            yield _visits(out)

    return found.filter("units is not null").select("vector_id", "vector", "cell", "floor", "units").mapInArrow(send, VISITS)


def _visited(rows: DataFrame, size: int, k: int, cells, layout, parts: dict[int, int], most: int) -> DataFrame:
    """Each distinct vector of a batch whose unit is asked, once for every part of those that ask."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _members(batch, size)
            if not len(x):
                continue
            same: dict[bytes, list[int]] = defaultdict(list)
            for i, row in enumerate(x):
                same[_vector_id(row)].append(i)
            firsts = x[[same[v][0] for v in same]]
            centre, cosine = cells.value.nearest(_unit(firsts))
            out: list[list] = [[] for _ in _VISITS]
            for v, row, c, near in zip(same, firsts, centre.tolist(), cosine.tolist(), strict=True):
                unit = layout.value.unit(c, v)
                smallest = sorted({int(ids[i]) for i in same[v]})[: k + 1]
                for part in range(parts.get(unit, 0)):
                    for column, value in zip(out, (unit * most + part, False, v, row.tobytes(), c, None, c, near, smallest), strict=True):
                        column.append(value)
            yield _visits(out)

    return rows.mapInArrow(send, VISITS)


def _visit(table: pa.Table, cells: Cells, k: int, size: int, step: int = 512) -> pa.Table:
    """Best k + 1 that vectors of other cells find in one unit, as far as they reach their k-th best so far."""
    asks = table.column("asks")
    guests, hosts = table.filter(asks), table.filter(pc.invert(asks))
    names, kept = guests.column("vector_id").to_pylist(), []
    if len(guests) and len(hosts):
        stored, cell, floor = _stored(guests, size), guests.column("cell").to_numpy(), guests.column("floor").to_numpy().copy()
        theirs, ids, cosine = _unit(_stored(hosts, size)), hosts.column("ids").to_pylist(), hosts.column("cosine").to_numpy()
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for j, key in enumerate(zip(hosts.column("centre").to_pylist(), np.searchsorted(SHELLS, cosine).tolist(), strict=True)):
            groups[key].append(j)
        angle = _angle(cosine)
        reach = Reach([(c, float(angle[g].min()), float(angle[g].max())) for (c, _), g in groups.items()], cells)
        for part in _blocks(0, len(names), step):
            own, least = _unit(stored[part]), floor[part]
            found: list[set[tuple[float, int]]] = [set() for _ in own]
            for wanted, group in zip(reach.of(own, least, cell[part]).T, groups.values(), strict=True):
                who = np.flatnonzero(wanted)
                for block in _blocks(0, len(group), 2048) if len(who) else []:
                    members = np.array(group[block])
                    i, j = np.nonzero(own[who] @ theirs[members].T >= least[who][:, None] - 1e-9)
                    i, j = who[i], members[j]
                    # few at once, as each pair takes two whole vectors
                    for at in _blocks(0, len(i), 1024):
                        exact = np.clip(np.round(np.einsum("ij,ij->i", own[i[at]], theirs[j[at]]), 12), -1, 1)
                        for a, b, c in zip(i[at].tolist(), j[at].tolist(), exact.tolist(), strict=True):
                            found[a].update((-c, x) for x in ids[b])
                    for a in set(i.tolist()):
                        if len(found[a]) > k:
                            best = sorted(found[a])[: k + 1]
                            found[a], least[a] = set(best), max(least[a], -best[-1][0] - 1e-9)
            kept += [[{"distance": d, "id": x} for d, x in sorted(f)[: k + 1]] for f in found]
    else:
        kept = [[] for _ in names]
    return pa.table({"vector_id": pa.array(names, pa.binary()), "hits": pa.array(kept, _HITS)}).filter(pa.array([bool(f) for f in kept], pa.bool_()))


# --- the operator -----------------------------------------------------------------------------------------------------


def _vector_of(rows: DataFrame, size: int) -> DataFrame:
    """(id, vector_id), one row for each member id; of an id with several vectors the smallest vector_id counts."""

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _members(batch, size)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_vector_id(r) for r in x], pa.binary())], names=["id", "vector_id"])

    return rows.mapInArrow(name, "id long, vector_id binary").groupBy("id").agg(F.min("vector_id").alias("vector_id"))


def _merge_hits(hits: DataFrame, k: int) -> DataFrame:
    """(vector_id, hits): the best k + 1 of the sorted lists of each vector."""

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ((v, [(h["distance"], h["id"]) for h in found]) for batch in batches for v, found in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        names, best = [], []
        for name, of_one in groupby(lists, lambda x: x[0]):
            kept: list[dict] = []
            for distance, x in merge(*(found for _, found in of_one)):
                if not kept or (kept[-1]["distance"], kept[-1]["id"]) != (distance, x):
                    kept.append({"distance": distance, "id": x})
                if len(kept) > k:
                    break
            names.append(name)
            best.append(kept)
            if len(names) == UNIT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(best, _HITS)], names=["vector_id", "hits"])
                names, best = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(best, _HITS)], names=["vector_id", "hits"])

    return hits.repartition("vector_id").sortWithinPartitions("vector_id").mapInArrow(tell, HITS)


def nearest(df: DataFrame, key: str, vector: str, k: int, size: int, unit_rows: int = UNIT_ROWS, probes: int | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar members of every member, by cosine; exact without ``probes``."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    cells, measured = fit_cells(rows, size)
    counts: dict[int, int] = defaultdict(int)
    for shell in measured:
        counts[shell.centre] += shell.n
    plan = Layout(counts, unit_rows)
    context = rows.sparkSession.sparkContext
    layout = context.broadcast(plan)
    shells = [(s.centre, s.least, s.greatest) for s in measured] if len(counts) > 1 else []  # a single cell has no others
    reach = context.broadcast(Reach(shells, cells.value))
    aligned = _alignment(rows, size, cells) if shells and probes is not None else 1.0
    # as many tasks as tiles, so that what one of them holds does not grow with the rows
    sent = _send(rows, size, k, cells, layout).repartition(max(1, len(plan.tiles)), "tile")
    found = sent.groupBy("tile").applyInArrow(lambda table: _tile(table, reach.value, layout.value, k, size, probes, aligned), FOUND)
    hits = found.select("vector_id", "hits")
    if shells:
        found = written(found)
        hits = found.select("vector_id", "hits")
        # those that ask one unit are spread, so that a task holds about as many of them as of the unit's own rows
        parts = {r.unit: -(-r.n // (2 * unit_rows)) for r in found.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n")).collect()}
        if parts:
            most = max(parts.values())
            visits = _visiting(found, parts, most).unionAll(_visited(rows, size, k, cells, layout, parts, most))
            visits = visits.repartition(sum(parts.values()), "tile")
            hits = hits.unionAll(visits.groupBy("tile").applyInArrow(lambda table: _visit(table, cells.value, k, size), HITS))
    return (
        _vector_of(rows, size)
        .join(_merge_hits(hits, k), "vector_id")
        .select("id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
        .select("id", F.posexplode("hits").alias("at", "hit"))
        .select("id", F.col("hit.id").alias("neighbour"), (-F.col("hit.distance")).alias("similarity"), (F.col("at") + 1).alias("rank"))
    )


def neighbour_pairs(df: DataFrame, key: str, vector: str, k: int, size: int, probes: int | None = None) -> DataFrame:
    """(a, b), a < b: one of the two is among the k most similar members of the other."""
    near = nearest(df, key, vector, k, size, probes=probes)
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
