"""Irregular readings onto a regular grid, with singular-spectrum imputation.

Readings fall into slots of the grid; each entity's slots are cut into chunks,
and a chunk also gets the slots shortly before and after it, so that a stretch
to be filled and its surroundings lie in one group whichever chunk they begin
in.  A group is at most ``chunk`` + 2 ``halo`` slots, however many readings an
entity has.  Within a group the bucketed series is cut into blocks; each block's
empty slots are filled by singular-spectrum imputation: embed the series in a
Hankel trajectory matrix, keep the leading singular vectors, and move the empty
slots to where averaging the diagonals and replacing them would end, until they
no longer move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _gram(x: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """Trajectory matrix times its transpose (n, window, window), from lagged products only; x is 0 behind each size."""
    cols = size - window + 1
    near = np.where(np.arange(x.shape[1]) < cols[:, None], x, 0.0)
    end = np.take_along_axis(x, cols[:, None] + np.arange(window - 1), axis=1)
    out = np.empty((len(x), window, window))
    for lag in range(window):
        more = window - 1 - lag
        first = np.einsum("ij,ij->i", near[:, : x.shape[1] - lag], x[:, lag:])[:, None]
        step = end[:, :more] * end[:, lag:] - x[:, :more] * x[:, lag : window - 1]
        i = np.arange(window - lag)
        out[:, i, i + lag] = out[:, i + lag, i] = np.concatenate([first, first + np.cumsum(step, axis=1)], axis=1)
    return out


def _nodes(missing: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The missing entries of a series in rows of up to ``width`` (-1 behind them), and how each row follows the one before.

    0 stands for next to it; q for 2^q - 1 rows left out between the two.  Rows
    are left out inside long gaps, where they all look alike: no known entry and
    no end of the series within reach.
    """
    edges = np.flatnonzero(np.diff(missing.view(np.int8), prepend=0, append=0))
    rows, links, waiting = [], [], []

    def flush() -> None:
        if waiting:
            entries = np.concatenate(waiting)
            entries = np.append(entries, np.full(-len(entries) % width, -1)).reshape(-1, width)
            rows.append(entries)
            links.extend([0] * len(entries))
            waiting.clear()

    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - begin < 4 * width or begin < width or end > size - width:
            waiting.append(np.arange(begin, end))
            continue
        flush()
        starts, more = [begin], (end - begin) // width - 1
        while more:
            links.append(len(bin(more)) - 3)
            starts.append(starts[-1] + (width << links[-1]))
            more -= 1 << links[-1]
        links.insert(len(links) - len(starts) + 1, 0)
        rows.append(np.array(starts)[:, None] + np.arange(width))
        if starts[-1] + width < end:
            waiting.append(np.arange(starts[-1] + width, end))
    flush()
    return np.concatenate(rows), np.array(links)


class _Missing:
    """The least-squares problem of the missing entries of n series, for any given singular vectors.

    What the trailing vectors see of the trajectory matrix is a quadratic form of
    the series with a band of window - 1 on either side; over the missing entries
    it is block tridiagonal, and is solved by elimination, series side by side.
    The rows that _nodes left out are alike, so they are eliminated by doubling:
    what a stretch of 2^q - 1 of them does to the rows at its ends follows from
    two stretches of half the length and the row between them.  The series come
    by falling number of rows; rows lie one after the other by their place in the
    series, then by series.
    """

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray, window: int):
        self.window, self.width, self.size = window, window - 1, size
        blocks = np.array([len(links) for _, links in nodes])
        at = np.full((len(size), blocks.max(), self.width), -1)
        link = np.zeros((len(size), blocks.max()), dtype=np.int64)
        for k, (rows, links) in enumerate(nodes):
            at[k, : len(links)], link[k, : len(links)] = rows, links
        place, self.row = np.nonzero(np.arange(blocks.max())[:, None] < blocks)
        self.place, self.at, self.link = place, at[self.row, place], link[self.row, place]
        before = np.where(place[:, None] > 0, at[self.row, place - 1], -1)
        self.inner = self._lags(self.at[:, :, None], self.at[:, None, :])
        self.outer = self._lags(before[:, :, None], self.at[:, None, :])
        # Stretches left out, from the longest: their series, and where the rows at their ends begin.
        self.spans: list[np.ndarray] = []
        left = np.zeros((3, 0), dtype=np.int64)
        for q in range(int(self.link.max()), 0, -1):
            own = np.flatnonzero(self.link == q)
            left = np.concatenate([left, [self.row[own], before[own, 0], self.at[own, 0]]], axis=1)
            self.spans.append(left)
            middle = (left[1] + left[2]) // 2
            left = np.concatenate([[left[0], left[1], middle], [left[0], middle, left[2]]], axis=1)

    def _lags(self, a: np.ndarray, b: np.ndarray) -> tuple:
        """Lag of the entries a and b (window if apart); for those near an end: where they are, and the bounds of their sum."""
        lag, early = np.abs(a - b), np.minimum(a, b)
        near = (lag < self.window) & (early >= 0)
        cols = (self.size - self.window + 1)[self.row][:, None, None]
        edge = np.nonzero(near & ((early < self.width - lag) | (early >= cols)))
        lag = np.where(near, lag, self.window)
        far, early = lag[edge], early[edge]
        return lag, edge, np.minimum(early, self.width - far) + 1, np.maximum(0, early - np.broadcast_to(cols, lag.shape)[edge] + 1)

    def only(self, keep: np.ndarray) -> None:
        """Drops the other series."""
        mine, number = keep[self.row], np.cumsum(keep) - 1
        spot = np.cumsum(mine) - 1
        for name in ("inner", "outer"):
            lag, edge, stop, begin = getattr(self, name)
            stay = mine[edge[0]]
            setattr(self, name, (lag[mine], (spot[edge[0][stay]], edge[1][stay], edge[2][stay]), stop[stay], begin[stay]))
        spans = [s[:, keep[s[0]]] for s in self.spans]
        self.spans = [np.concatenate([number[s[:1]], s[1:]]) for s in spans]
        self.row, self.place, self.at, self.link, self.size = number[self.row[mine]], self.place[mine], self.at[mine], self.link[mine], self.size[keep]

    def _band(self, sums: np.ndarray, lags: tuple) -> np.ndarray:
        lag, edge, stop, begin = lags
        whole = np.append(sums[:, :, -1], np.zeros((len(sums), 1)), axis=1)
        out = whole.ravel()[lag + (self.row * (self.window + 1))[:, None, None]]
        row, far = self.row[edge[0]], lag[edge]
        out[edge] = sums[row, far, stop] - sums[row, far, begin]
        return out

    def _times(self, trailing: np.ndarray, sums: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The form's matrix times x, which is 0 behind each size."""
        w, d, m = self.window, self.width, x.shape[1]
        out = sums[:, 0, -1:] * x
        for lag in range(1, w):
            out[:, : m - lag] += sums[:, lag, -1:] * x[:, lag:]
            out[:, lag:] += sums[:, lag, -1:] * x[:, : m - lag]
        # Less the windows that would run over an end.
        pad = np.pad(x, ((0, 0), (d, 2 * d)))
        place = np.arange(w)[:, None] + np.arange(d)
        cols = (self.size - d)[:, None]
        for begin in (np.zeros_like(cols), cols + d):
            part = trailing @ np.take_along_axis(pad, begin + np.arange(2 * d), axis=1)[:, place]
            over = np.zeros((len(x), 2 * d))
            for i in range(w):
                over[:, i : i + d] += part[:, i]
            if begin[0, 0]:
                mine = (np.arange(len(x))[:, None], cols + np.arange(d))
                out[mine] -= over[:, :d]
            else:
                out[:, :d] -= over[:, d:]
        return out

    def _doubled(self, sums: np.ndarray, ridge: float) -> tuple[np.ndarray, list[tuple]]:
        """The series with stretches left out, and for q = 0, 1, ... what a stretch of 2^q - 1 rows does.

        That is: what it takes from the row before and the row behind it, how it
        couples the two, and the matrices that give its middle row from the two
        (for q = 0 there is none).
        """
        w, d = self.window, self.width
        own = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[s[0] for s in self.spans]]))
        i = np.arange(d)
        whole = np.append(sums[own, :, -1], np.zeros((len(own), 1)), axis=1)
        plain = whole[:, np.abs(i[:, None] - i)] + ridge * np.eye(d)
        couple = whole[:, np.minimum(d + i - i[:, None], w)]
        before = behind = np.zeros_like(plain)
        out = [(before, behind, couple, couple, couple)]
        for _ in self.spans:
            turned = couple.transpose(0, 2, 1)
            got = np.linalg.solve(plain - before - behind, np.concatenate([turned, couple], axis=2))
            back, ahead = got[:, :, :d], got[:, :, d:]
            before, behind, couple = before + couple @ back, behind + turned @ ahead, -couple @ ahead
            out.append((before, behind, couple, back, ahead))
        return own, out

    def solve(self, trailing: np.ndarray, x: np.ndarray, ridge: float) -> np.ndarray:
        """x with the missing entries that leave least to the trailing projection (n, window, window).

        ridge holds entries that nothing determines at the mean.
        """
        w = self.window
        sums = np.zeros((len(x), w, w + 1))
        for lag in range(w):
            i = np.arange(w - lag)
            sums[:, lag, 1 : w - lag + 1] = np.cumsum(trailing[:, i, i + lag], axis=1)
            sums[:, lag, w - lag + 1 :] = sums[:, lag, w - lag : w - lag + 1]
        there = self.at >= 0
        spot = (np.broadcast_to(self.row[:, None], self.at.shape)[there], self.at[there])
        fixed = x.copy()
        fixed[spot] = 0.0
        for row, left, right_ in self.spans:
            middle = (left + right_) // 2
            fixed[row[:, None], middle[:, None] + np.arange(self.width)] = 0.0
        right = np.zeros(self.at.shape)
        right[there] = -self._times(trailing, sums, fixed)[spot]
        inner, outer = self._band(sums, self.inner), self._band(sums, self.outer)
        i = np.arange(self.width)
        inner[:, i, i] += np.where(there, ridge, 1.0)
        bounds = np.append(np.flatnonzero(np.diff(self.place, prepend=-1)), len(self.place))
        own, doubled = self._doubled(sums, ridge)
        far = np.flatnonzero(self.link > 0)
        # The row before another one of a series stands at the same place among those of the place before.
        near = bounds[self.place[far] - 1] + far - bounds[self.place[far]]
        for q in np.unique(self.link[far]):
            pick = self.link[far] == q
            mine = np.searchsorted(own, self.row[far[pick]])
            inner[near[pick]] -= doubled[q][0][mine]
            inner[far[pick]] -= doubled[q][1][mine]
            outer[far[pick]] = doubled[q][2][mine]
        ahead, got = np.zeros_like(outer), np.zeros(self.at.shape)
        steps = list(zip(bounds[:-1], bounds[1:], strict=True))
        for j, (lo, hi) in enumerate(steps):
            d, y = inner[lo:hi], right[lo:hi, :, None]
            if j:
                past = steps[j - 1][0]
                back = outer[lo:hi].transpose(0, 2, 1)
                d, y = d - back @ ahead[past : past + hi - lo], y - back @ got[past : past + hi - lo, :, None]
            more = bounds[j + 2] - hi if j + 2 < len(bounds) else 0
            if more:
                done = np.linalg.solve(d[:more], np.concatenate([outer[hi : hi + more], y[:more]], axis=2))
                ahead[lo : lo + more], got[lo : lo + more] = done[:, :, :-1], done[:, :, -1]
            if more < hi - lo:
                got[lo + more : hi] = np.linalg.solve(d[more:], y[more:])[:, :, 0]
        for (lo, _), (nxt, end) in reversed(list(zip(steps, steps[1:], strict=False))):
            k = end - nxt
            got[lo : lo + k] -= (ahead[lo : lo + k] @ got[nxt:end, :, None])[:, :, 0]
        out = x.copy()
        out[spot] = got[there]
        for k, (row, left, right_) in enumerate(self.spans):
            mine = np.searchsorted(own, row)
            *_, to_left, to_right = doubled[len(self.spans) - k]
            at = lambda begin, row=row: (row[:, None], begin[:, None] + i)
            out[at((left + right_) // 2)] = -(to_left[mine] @ out[at(left)][:, :, None] + to_right[mine] @ out[at(right_)][:, :, None])[:, :, 0]
        return out


def ssa_settle(
    series: np.ndarray, known: np.ndarray, size: np.ndarray | None = None, *, window: int = 12, rank: int = 3, rounds: int = 100, tolerance: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Series (n, m) with the unknown entries filled, n series at once, and whether each of them settled.

    Unknown entries start on the line between their known neighbours.  Replacing
    them by the averaged diagonals of the leading part again and again walks down
    what the trailing vectors hold of the trajectory matrix; a round here goes
    there at once: it takes the singular vectors, then solves for the entries at
    which the replacing under these vectors would end.  The rounds end when the last
    change, and the distance still to go as judged by the last two changes, are at
    most tolerance standard deviations of the series; one that is further off after
    ``rounds`` of them is not settled.  Series too short for two windows stay on
    the line.  size is the length of each series if they differ; what lies
    behind it is ignored.
    """
    n, m = series.shape
    size = np.full(n, m) if size is None else size
    at = np.arange(m)
    inside = at < size[:, None]
    out, settled = np.where(known, series, 0.0), np.ones(n, dtype=bool)
    missing = ~known & inside
    for k in range(n):
        good = known[k, : size[k]]
        out[k, : size[k]] = np.interp(at[: size[k]], at[: size[k]][good], series[k, : size[k]][good])
    todo = np.flatnonzero(missing.any(axis=1) & (size >= 2 * window)) if rank < window else np.zeros(0, dtype=int)
    if not todo.size:
        return out, settled
    whole = size[todo, None]
    mean = np.where(inside[todo], out[todo], 0.0).sum(axis=1, keepdims=True) / whole
    x = np.where(inside[todo], out[todo] - mean, 0.0)
    scale = np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True) / whole), 1e-9)
    x /= scale
    nodes = [_nodes(missing[k, : size[k]], size[k], window - 1) for k in todo.tolist()]
    before = np.full(len(todo), np.inf)

    def advance(open_: np.ndarray, rounds: int) -> np.ndarray:
        """Moves the series for some rounds; those that haven't settled then."""
        if not open_.size:
            return open_
        open_ = open_[np.argsort([-len(nodes[k][1]) for k in open_.tolist()], kind="stable")]
        far = size[todo[open_]].max()
        problem = _Missing([nodes[k] for k in open_.tolist()], size[todo[open_]], window)
        for _ in range(rounds):
            part = x[open_, :far]
            _, vectors = np.linalg.eigh(_gram(part, problem.size, window))
            rest = vectors[:, :, :-rank]
            x[open_, :far] = new = problem.solve(rest @ rest.transpose(0, 2, 1), part, 1e-9)
            moved = np.abs(new - part).max(axis=1)
            pace = np.where(np.isinf(before[open_]), 1.0, moved / np.maximum(before[open_], 1e-300))
            more = moved > tolerance * np.clip(1 / np.maximum(pace, 1e-9) - 1, 1e-4, 1.0)
            before[open_] = moved
            open_ = open_[more]
            if not open_.size:
                break
            if not more.all():
                problem.only(more)
        return open_

    # Most settle soon, among others of about their length; the few that don't go on together.
    first = min(rounds, 12)
    about = np.ceil(np.log2(size[todo]))
    left = np.concatenate([advance(np.flatnonzero(about == a), first) for a in np.unique(about)])
    left = advance(left, rounds - first)
    settled[todo[left]] = False
    out[todo] = np.where(missing[todo], x * scale + mean, out[todo])
    return out, settled


def ssa_fill(series: np.ndarray, known: np.ndarray, **options) -> np.ndarray:
    """The series of ssa_settle."""
    return ssa_settle(series, known, **options)[0]


def _stretches(slots: np.ndarray, values: np.ndarray, low: int, high: int, longest: int, block: int, context: int, limit: float):
    """Grid rows of the readings in [low, high): slot, value, first and last slot of the filled stretch (-1 if covered), settled; and the blocks to be filled.

    slots are sorted and distinct.  Each covered slot of the chunk brings itself
    and the empty stretch behind it, if that has at most ``longest`` slots and a
    covered one behind it.
    """
    own = np.flatnonzero((slots >= low) & (slots < high))
    if not own.size:
        return None
    follow = np.append(np.diff(slots) - 1, longest + 1)
    empty = np.where(follow <= longest, follow, 0)
    total = 1 + empty[own]
    starts = np.cumsum(total) - total
    n = int(total.sum())
    offset = np.arange(n) - np.repeat(starts, total)
    slot = np.repeat(slots[own], total) + offset
    filled = offset > 0
    first = np.where(filled, np.repeat(slots[own] + 1, total), -1)
    last = np.where(filled, np.repeat(slots[own] + empty[own], total), -1)
    value = np.repeat(values[own], total)
    values = np.clip(values, -limit, limit)
    # Blocks lie on the absolute grid, so that the result doesn't depend on the chunks.
    number = slots // block
    gaps = own[empty[own] > 0]
    settled = np.ones(n, dtype=bool)
    members: list[tuple[np.ndarray, np.ndarray, int, int]] = []
    for b in np.unique(number[gaps]):
        inside = gaps[number[gaps] == b]
        left, right = int(inside[0]), int(inside[-1]) + 1
        # Only what belongs to the same recording serves as surroundings.
        start = left
        while start > 0 and slots[left] - slots[start - 1] <= context and follow[start - 1] <= longest:
            start -= 1
        stop = right
        while stop + 1 < len(slots) and slots[stop + 1] - slots[right] <= context and follow[stop] <= longest:
            stop += 1
        base = int(slots[start])
        m = int(slots[stop]) - base + 1
        series, known = np.zeros(m), np.zeros(m, dtype=bool)
        at = slots[start : stop + 1] - base
        series[at], known[at] = values[start : stop + 1], True
        members.append((series, known, base, b))
    return (slot, value, first, last, settled), members


def _fill(made: list[tuple], longest: int, block: int, limit: float) -> None:
    """Fills the blocks of all of made (results of _stretches) in place, side by side."""
    members = [(rows, *m) for rows, blocks in made for m in blocks]
    if not members:
        return
    size = np.array([len(m[1]) for m in members])
    stack = lambda k: np.stack([np.pad(m[k], (0, size.max() - len(m[k]))) for m in members])
    done, calm = ssa_settle(stack(1), stack(2), size)
    calm &= np.abs(done).max(axis=1) <= limit
    done = np.clip(done, -limit, limit)
    for filling, ok, ((slot, value, first, _, settled), _, _, base, b) in zip(done, calm, members, strict=True):
        lo, hi = np.searchsorted(slot, [b * block, (b + 1) * block + longest + 1])
        mine = np.flatnonzero((first[lo:hi] >= 0) & ((first[lo:hi] - 1) // block == b)) + lo
        value[mine], settled[mine] = filling[slot[mine] - base], ok


def _groups(batches, keys: list[str]):
    """Tables of rows with the same keys from record batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and any(rest[0].column(k)[0] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            change |= pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if lo:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield pa.Table.from_batches(rest)


def regular_grid(
    readings: DataFrame,
    *,
    id_col: str,
    key_col: str,
    slot: F.Column | str,
    value_cols: dict[str, str],
    longest: int = 2999,
    chunk: int = 30_720,
    block: int = 1024,
    context: int = 64,
    limit: float = 16.0,
    together: int = 1024,
) -> DataFrame:
    """Rows (key_col, sensor, slot, value, filled, gap_first, gap_last, settled) of a regular series per entity and sensor.

    value_cols maps the name of a sensor to its column.  A slot is covered if a
    reading in it has a value (neither NULL nor NaN) of that sensor; its value is
    their mean.  Stretches of up to ``longest`` empty slots between two covered
    ones are filled and marked (gap_first and gap_last are the stretch's slots);
    longer ones part recordings and give no rows.  Values beyond +-``limit`` are
    impossible: they stand as they are, but filling takes them as the limit.  settled is false in filled
    stretches of a block whose filling did not converge or ran beyond the limit, where it is cut off.  Readings with a NULL key or
    slot take no part; each id counts once; other columns are ignored; an
    entity without values and an empty table give no rows.  chunk is a multiple
    of block, so blocks, and with them the filled values, don't depend on it.
    A task fills about ``together`` blocks at once, of several groups.
    """
    if chunk % block:
        raise ValueError("chunk must be a multiple of block")
    halo = longest + context + 2
    names, cols = list(value_cols), list(value_cols.values())
    at = F.expr(slot) if isinstance(slot, str) else slot
    given = readings.select(F.col(key_col).alias("key"), F.col(id_col).alias("id"), at.alias("slot"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    # Copies go before the chunks are formed, so a group of them can't fill one.
    given = given.where("key IS NOT NULL AND slot IS NOT NULL").distinct()
    home = F.floor(F.col("slot") / chunk)
    # A slot near a border also goes to the neighbouring chunks; the set drops the usual case of one chunk.
    reach = F.array_distinct(F.array(home, F.floor((F.col("slot") - halo) / chunk), F.floor((F.col("slot") + halo) / chunk)))
    spread = given.withColumn("chunk", F.explode(reach))

    types = {"key": None, "sensor": pa.string(), "slot": pa.int64(), "value": pa.float64(), "gap_first": pa.int64(), "gap_last": pa.int64(), "settled": pa.bool_()}

    def found(group: pa.Table):
        ident, slots = group.column("id").to_numpy(), group.column("slot").to_numpy()
        order = np.lexsort((ident, slots))
        keep = np.ones(len(order), dtype=bool)
        keep[1:] = (np.diff(slots[order]) != 0) | (ident[order][1:] != ident[order][:-1])
        order = order[keep]
        low = group.column("chunk")[0].as_py() * chunk
        for k, name in enumerate(names):
            v = group.column(f"v{k}").to_numpy(zero_copy_only=False).astype(float)[order]
            good = ~np.isnan(v)
            if not good.any():
                continue
            covered, inverse = np.unique(slots[order][good], return_inverse=True)
            mean = np.bincount(inverse, v[good]) / np.bincount(inverse)
            made = _stretches(covered, mean, low, low + chunk, longest, block, context, limit)
            if made is not None:
                yield name, made

    def finish(waiting: list[tuple]):
        _fill([made for *_, made in waiting], longest, block, limit)
        for key, name, (arrays, _) in waiting:
            zero = pa.array(np.zeros(len(arrays[0]), dtype=np.int32))
            columns = [pa.array([key], type=key.type).take(zero), pa.array([name]).take(zero), *[pa.array(x) for x in arrays]]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, [key.type, *list(types.values())[1:]], strict=True)], names=list(types))

    def fill(batches):
        # Groups wait for each other, because blocks are filled much faster side by side.
        waiting, blocks, rows = [], 0, 0
        for group in _groups(batches, ["key", "chunk"]):
            for name, made in found(group):
                waiting.append((group.column("key")[0], name, made))
                blocks, rows = blocks + len(made[1]), rows + len(made[0][0])
            if blocks >= together or rows >= 64 * chunk:
                yield from finish(waiting)
                waiting, blocks, rows = [], 0, 0
        yield from finish(waiting)

    key_type = given.schema["key"].dataType.simpleString()
    near = spread.repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    series = near.mapInArrow(fill, f"key {key_type}, sensor string, slot bigint, value double, gap_first bigint, gap_last bigint, settled boolean")
    mark = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return series.select(
        F.col("key").alias(key_col), "sensor", "slot", "value", (F.col("gap_first") >= 0).alias("filled"), mark("gap_first"), mark("gap_last"), "settled"
    )


def filled_stretches(series: DataFrame, *, key_col: str, shortest: int = 5) -> DataFrame:
    """Rows (key_col, sensor, first_slot, last_slot) of the filled stretches of a regular_grid result."""
    begins = series.where(F.col("filled") & (F.col("slot") == F.col("gap_first")) & (F.col("gap_last") - F.col("gap_first") + 1 >= shortest))
    return begins.select(key_col, "sensor", F.col("gap_first").alias("first_slot"), F.col("gap_last").alias("last_slot"))
