"""Exact cosine search in Arrow batches: a matrix product finds candidates, sums in the order of the elements decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast

#: Points that are scored together: elements and rows at most.
TILE_FLOATS, TILE_ROWS = 1 << 22, 1 << 15
#: Points a group, whose greatest score is compared first; queries a product; pairs that are summed together.
GROUP, QUERY_ROWS, PAIRS = 32, 64, 1 << 14
#: The key that rows of both sides must share is a string column of this name.
KEY = "_search_key"
#: Squared norms between which products of two cannot leave the range of doubles.
LEAST, MOST = 1e-140, 1e140


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of a and b, added in the order of the elements as SQL adds them."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Vectors:
    """The vectors of a list column by their length; rows without a direction (null, a null in it, norm 0) have length 0."""

    def __init__(self, column: pa.Array):
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        if flat.null_count:
            lengths = lengths.copy()
            lengths[np.repeat(np.arange(len(lengths)), lengths)[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
        self.length, self.place, self.of = lengths, np.zeros(len(lengths), np.int64), {}
        for n in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == n)
            matrix = values[starts[rows][:, None] + np.arange(n)]
            norms = summed(matrix, matrix)
            self.length[rows[norms == 0]] = 0
            self.place[rows] = np.arange(len(rows))
            self.of[n] = matrix, norms

    def take(self, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        matrix, norms = self.of[n]
        at = self.place[rows]
        return matrix[at], norms[at]


def by_key(table: pa.Table) -> dict:
    """Row numbers, ascending, by the key column; all under None where there is none."""
    if KEY not in table.column_names:
        return {None: np.arange(table.num_rows)}
    if not table.num_rows:
        return {}
    codes = table.column(KEY).combine_chunks().dictionary_encode()
    at = codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    return dict(zip(codes.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(at, minlength=len(codes.dictionary)))[:-1]), strict=True))


def _first_equals(matrix: np.ndarray, norms: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k earlier ones equal: these have the same score and a smaller id."""
    _, at, n = np.unique(norms, return_inverse=True, return_counts=True)
    many = np.flatnonzero(n[at] > k)
    if not len(many):
        return np.arange(len(norms))
    rows = np.ascontiguousarray(matrix[many])
    _, same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
    later = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) >= k
    keep = np.ones(len(norms), bool)
    keep[many[order[later]]] = False
    return np.flatnonzero(keep)


def _cosines(q, nq, p, np_, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for s in range(0, len(i), PAIRS):
        a, b = i[s : s + PAIRS], j[s : s + PAIRS]
        out[s : s + PAIRS] = np.clip(summed(q[a], p[b]) / np.sqrt(nq[a] * np_[b]), -1, 1)
    return out


def top(q: np.ndarray, nq: np.ndarray, p: np.ndarray, np_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, cosine) of each query's k best points, the earlier of equals; NaN is above all.

    A product of unit vectors differs from the cosine by less than ``slack``: whatever it puts below the k-th greatest of the
    groups' maxima by more than that is not among the k best.  Norms out of range are candidates of every query."""
    first = _first_equals(p, np_, k)
    p, np_ = p[first], np_[first]
    with np.errstate(all="ignore"):
        sound, asked = ((LEAST < x) & (x < MOST) for x in (np_, nq))
        m, groups = len(p), -(-len(p) // GROUP)
        units = np.zeros((GROUP * groups, p.shape[1]))
        units[:m][sound] = p[sound] / np.sqrt(np_[sound])[:, None]
        hidden = np.r_[np.flatnonzero(~sound), np.arange(m, len(units))]
        odd, slack, out = np.flatnonzero(~sound), 2e-15 * (p.shape[1] + 16), []
        for s in range(0, len(q), QUERY_ROWS):
            ok = asked[s : s + QUERY_ROWS]
            unit = np.where(ok[:, None], q[s : s + QUERY_ROWS] / np.sqrt(nq[s : s + QUERY_ROWS])[:, None], 0)
            scores = unit @ units.T
            scores[:, hidden] = -np.inf
            scores = scores.reshape(len(unit), GROUP, groups)
            most = scores.max(axis=1)
            least = np.partition(most, groups - k, axis=1)[:, groups - k] - slack if groups >= k else np.full(len(unit), -np.inf)
            least[~ok] = -np.inf
            i, g = np.nonzero(most >= least[:, None])
            n, x = np.nonzero(scores[i, :, g] >= least[i][:, None])
            i, j = i[n], x * groups + g[n]
            seen = j < m
            seen[seen] = sound[j[seen]]
            i, j = np.r_[i[seen], np.repeat(np.arange(len(unit)), len(odd))], np.r_[j[seen], np.tile(odd, len(unit))]
            got = _cosines(q, nq, p, np_, i + s, j)
            order = np.lexsort((j, np.where(np.isnan(got), -np.inf, -got), i))
            i, j, got = i[order], j[order], got[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((i[best] + s, first[j[best]], got[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pairs(queries: Vectors, asking: dict, points: Vectors, stored: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, score, whether the score is null): at least each query's k best points under its key."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
    for key, ps in stored.items():
        qs = asking.get(key, ())
        for n in np.unique(queries.length[qs]).tolist() if len(qs) else ():
            mine = qs[queries.length[qs] == n]
            fit = ps[points.length[ps] == n] if n else ps[:0]
            if len(fit):
                i, j, score = top(*queries.take(mine, n), *points.take(fit, n), k)
                out.append((mine[i], fit[j], score, np.zeros(len(i), bool)))
            if len(fit) < k:
                rest = (ps[points.length[ps] != n] if n else ps)[:k]
                size = len(mine) * len(rest)
                out.append((np.repeat(mine, len(rest)), np.tile(rest, len(mine)), np.zeros(size), np.ones(size, bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def searcher(block: Broadcast, k: int, asked: list[str], stored: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over points: rows of ``asked`` columns of the block's queries, ``stored`` columns of points and the score,
    of each query's k best points among every few thousand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = block.value
        queries, asking = Vectors(table.column("query").combine_chunks()), by_key(table)

        def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile = pa.Table.from_batches(held)
            tile = tile.take(pc.sort_indices(tile, sort_keys=[("point_id", "ascending")], null_placement="at_start"))
            points = Vectors(tile.column("vector").combine_chunks())
            i, j, score, unknown = pairs(queries, asking, points, by_key(tile), k)
            columns = [*[table.column(c).take(pa.array(i)) for c in asked], *[tile.column(c).take(pa.array(j)) for c in stored], pa.array(score, pa.float64(), mask=unknown)]
            yield from pa.table(columns, names=[*asked, *stored, "score"]).combine_chunks().to_batches(max_chunksize=1 << 16)

        held, rows, floats = [], 0, 0
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                piece = batch.slice(s, 1024)
                n = len(piece.column("vector").flatten())
                if held and (rows + piece.num_rows > TILE_ROWS or floats + n > TILE_FLOATS):
                    yield from found(held)
                    held, rows, floats = [], 0, 0
                held.append(piece)
                rows, floats = rows + piece.num_rows, floats + n
        if held:
            yield from found(held)

    return run
