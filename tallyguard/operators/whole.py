"""Best matches among the few invoices a name can meet, by array arithmetic in a task.

A task receives whole groups of names that meet no others, each row once
(:func:`best_of_groups`); or, sorted by name, first the points a name can meet and then the
rows that ask under it (:func:`best_of_points`). Points are sorted by amount and by day once; the neighbours of a row give a
score it reaches, which bounds how far in amount (or, where amounts share nothing, in days)
anything at least as good may lie, and only points in that range are scored. What a
task holds is a batch of names, so memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyguard.policy import AMOUNT_TOLERANCE, DATE_WINDOW_DAYS, W_AMOUNT, W_DATE

#: What a task receives: ``kind`` 0 is a point, 1 a row that asks; ``id`` is the point's, or
#: the one that the row has to skip. Rows of one (name, part) come together, points first,
#: points by (id, vendor, amount, date), which decides between equal scores.
ASKED = "name string, part int, kind int, id string, vendor string, amount double, date date, v double"
FOUND = ("_vkey string, _amount double, _date date, _excl string, neg double, id string, "
         "vendor string, amount double, date date, v double")
#: What a group's rows carry besides their own columns: ``_kind`` 0 is a point, 1 a row that
#: asks, 2 both; ``_i`` numbers the names of the group, ``_vs`` tells how alike this row's
#: name is to each of them (0: no link). Rows without ``_i`` pass through unmatched.
GROUPED = "_group string, _i int, _vs array<double>, _kind int"
#: What rows that ask come back with: the best match, null without one.
BEST = "_neg double, _id string, _vendor string, _on_amount double, _on_date date, _v double"
_BATCH = 100_000        # rows searched together, and a name more
_PAIRS = 2_000_000      # pairs scored together
_SIDE = 3               # neighbours on each side that give the first score
_NONE = np.iinfo(np.int64).max


class _Axis:
    """Points of several names in the order of one value."""

    def __init__(self, group: np.ndarray, value: np.ndarray, points: np.ndarray):
        self.values = np.unique(value)
        key = (group << 32) | np.searchsorted(self.values, value)
        order = np.argsort(key, kind="stable")
        self.keys, self.points = key[order], points[order]

    def at(self, group: np.ndarray, value: np.ndarray, side: str = "left") -> np.ndarray:
        """Place of the first point of the group that is not below (right: above) the value."""
        return np.searchsorted(self.keys, (group << 32) | np.searchsorted(self.values, value, side))


class _Search:
    def __init__(self, rows: pa.Table, group: np.ndarray):
        def column(name: str, missing: float) -> np.ndarray:
            return pc.fill_null(rows[name].cast(pa.float64()), missing).to_numpy()

        asks = rows["kind"].to_numpy() == 1
        self.points, self.asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        ids = pc.fill_null(rows["id"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        days = pc.fill_null(rows["date"].cast(pa.int32()).cast(pa.float64()), np.nan).to_numpy()
        amount = rows["amount"].to_numpy()
        self.p_group, self.q_group = group[self.points], group[self.asked]
        self.p_id, self.q_id = ids[self.points], ids[self.asked]
        self.p_amount, self.q_amount = amount[self.points], amount[self.asked]
        self.p_day, self.q_day = days[self.points], days[self.asked]
        self.p_v = column("v", 1.0)[self.points]
        self.score = np.zeros(len(self.asked))
        self.best = np.full(len(self.asked), _NONE)

    def _alike(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        return self.p_v[p]

    def _scores(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        a, b = self.q_amount[q], self.p_amount[p]
        scale = np.maximum(np.maximum(np.abs(a), np.abs(b)), 1.0)
        amount = np.maximum(0.0, 1.0 - (np.abs(a - b) / scale) / AMOUNT_TOLERANCE)
        near = 1.0 - np.abs(self.q_day[q] - self.p_day[p]) / float(DATE_WINDOW_DAYS)
        date = np.where(near > 0.0, near, 0.0)      # also where a date is missing
        score = self._alike(q, p) * (W_AMOUNT * amount + W_DATE * date)
        return np.where(self.q_id[q] == self.p_id[p], 0.0, score)

    def reached(self, axis: _Axis, q: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A score that each row reaches, from its neighbours on the axis."""
        at, reached = axis.at(self.q_group[q], value), self.score[q]
        for step in range(-_SIDE, _SIDE):
            place = at + step
            inside = (place >= 0) & (place < len(axis.points))
            p = axis.points[np.where(inside, place, 0)]
            inside &= self.p_group[p] == self.q_group[q]
            reached = np.maximum(reached, np.where(inside, self._scores(q, p), 0.0))
        return reached

    def look(self, axis: _Axis, q: np.ndarray, value: np.ndarray, reach: np.ndarray) -> None:
        """Scores the points within reach on the axis and keeps the best of each row."""
        first = axis.at(self.q_group[q], value - reach)
        n = axis.at(self.q_group[q], value + reach, "right") - first
        q, first, n = q[n > 0], first[n > 0], n[n > 0]
        upto, start = np.cumsum(n), 0
        while start < len(q):
            before = upto[start] - n[start]
            end = max(start + 1, int(np.searchsorted(upto, before + _PAIRS, "right")))
            some, counts = q[start:end], n[start:end]
            heads = upto[start:end] - counts - before
            places = np.arange(counts.sum()) + np.repeat(first[start:end] - heads, counts)
            p = axis.points[places]
            scores = self._scores(np.repeat(some, counts), p)
            top = np.maximum.reduceat(scores, heads)
            won = np.minimum.reduceat(np.where(scores == np.repeat(top, counts), p, _NONE), heads)
            better = (top > self.score[some]) | ((top == self.score[some]) & (won < self.best[some]))
            better &= top > 0.0
            self.score[some[better]], self.best[some[better]] = top[better], won[better]
            start = end

    def run(self, least: float) -> None:
        if not len(self.points) or not len(self.asked):
            return
        every = np.arange(len(self.asked))
        axis = _Axis(self.p_group, self.p_amount, np.arange(len(self.points)))
        known = np.maximum(self.reached(axis, every, self.q_amount), least)
        share = np.clip((known - W_DATE) / W_AMOUNT, 0.0, 1.0)
        gap = AMOUNT_TOLERANCE * (1.0 - share) + 1e-9
        self.look(axis, every, self.q_amount,
                  gap * np.maximum(np.abs(self.q_amount), 1.0) / (1.0 - gap) + 1e-9)
        # What shares no amount scores on the date alone.
        if least > W_DATE:
            return
        left = np.flatnonzero((self.score <= W_DATE) & ~np.isnan(self.q_day))
        dated = np.flatnonzero(~np.isnan(self.p_day))
        if len(left) and len(dated):
            axis = _Axis(self.p_group[dated], self.p_day[dated], dated)
            known = np.maximum(self.reached(axis, left, self.q_day[left]), least)
            days = DATE_WINDOW_DAYS * (1.0 - np.clip(known / W_DATE, 0.0, 1.0)) + 1e-6
            self.look(axis, left, self.q_day[left], days)


class _GroupSearch(_Search):
    """Rows of whole groups, which are points, ask, or both."""

    def __init__(self, rows: pa.Table, group: np.ndarray):
        kind, amounts = rows["_kind"].to_numpy(), rows["amount"]
        usable = pc.and_kleene(rows["_i"].is_valid(), amounts.is_valid()).to_numpy()
        amount = pc.fill_null(amounts, np.nan).to_numpy()
        usable = usable & ~np.isnan(amount)
        self.asked = np.flatnonzero(usable & (kind > 0))
        points = np.flatnonzero(usable & (kind != 1) & rows["invoice_id"].is_valid().to_numpy())
        order = pc.sort_indices(rows.select(["invoice_id", "vendor", "amount", "posting_date"]).take(points),
                                sort_keys=[(c, "ascending") for c in (
                                    "invoice_id", "vendor", "amount", "posting_date")],
                                null_placement="at_start").to_numpy()
        ids = pc.fill_null(rows["invoice_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        days = pc.fill_null(rows["posting_date"].cast(pa.int32()).cast(pa.float64()), np.nan).to_numpy()
        name = pc.fill_null(rows["_i"], 0).to_numpy()
        self.points = _two_of_each(points[order], ids, [group, name, amount, np.nan_to_num(days, nan=1e9)])
        self.p_group, self.q_group = group[self.points], group[self.asked]
        self.p_id, self.q_id = ids[self.points], ids[self.asked]
        self.p_amount, self.q_amount = amount[self.points], amount[self.asked]
        self.p_day, self.q_day = days[self.points], days[self.asked]
        lists = rows["_vs"].combine_chunks()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        self.vs, self.p_name = lists.flatten().to_numpy(), name[self.points]
        self.q_vs = (np.cumsum(size) - size)[self.asked]
        self.score = np.zeros(len(self.asked))
        self.best = np.full(len(self.asked), _NONE)

    def _alike(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        # A neighbour on an axis may be of another group; its score is not used.
        at = np.where(self.q_group[q] == self.p_group[p], self.q_vs[q] + self.p_name[p], 0)
        return self.vs[at]


def _two_of_each(points: np.ndarray, ids: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Of the points equal in all keys those with the first two distinct ids, in the order given.

    Whoever has to skip the first is answered by the second.
    """
    order = np.lexsort([k[points] for k in reversed(keys)])     # stable
    at = points[order]
    fresh = np.ones(len(at), dtype=bool)
    if len(at):
        fresh[1:] = np.logical_or.reduce([k[at][1:] != k[at][:-1] for k in keys])
    other = fresh.copy()
    other[1:] |= ids[at][1:] != ids[at][:-1]
    nth = np.cumsum(other)
    first = np.maximum.accumulate(np.where(fresh, nth, 0))
    return points[np.sort(order[other & (nth - first < 2)])]


def _searched(rows: pa.Table, group: np.ndarray, least: float, schema: pa.Schema) -> pa.Table:
    search = _Search(rows, group)
    search.run(least)
    hit = np.flatnonzero(search.best != _NONE)
    asked = rows.take(search.asked[hit])
    found = rows.take(search.points[search.best[hit]])
    columns = [asked["name"], asked["amount"], asked["date"], asked["id"],
               pa.chunked_array([pa.array(-search.score[hit])]),
               found["id"], found["vendor"], found["amount"], found["date"], found["v"]]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _answered(rows: pa.Table, group: np.ndarray, least: float, own: list[str],
              schema: pa.Schema) -> pa.Table:
    search = _GroupSearch(rows, group)
    search.run(least)
    hit = search.best != _NONE
    # Place of the match and its score per row; rows without one stay null.
    place, neg = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    none, v = np.ones(len(rows), dtype=bool), np.zeros(len(rows))
    won, best = search.asked[hit], search.best[hit]
    place[won], neg[won], none[won] = search.points[best], -search.score[hit], False
    v[won] = search._alike(np.flatnonzero(hit), best)
    found = rows.select(["invoice_id", "vendor", "amount", "posting_date"]).take(pa.array(place, mask=none))
    best_columns = [pa.array(neg, mask=none), *found.columns, pa.array(v, mask=none)]
    columns = [*rows.select(own).columns, *(c.cast(f.type) for c, f in zip(best_columns, schema))]
    out = pa.Table.from_arrays(columns, names=[*own, *schema.names])
    kind = rows["_kind"].to_numpy()
    return out if (kind > 0).all() else out.filter(pa.array(kind > 0))


def _in_groups(keys: list[str], search):
    """Function for ``mapInArrow`` over rows sorted by the keys: whole groups go to ``search``."""
    def groups(rows: pa.Table) -> np.ndarray:
        changed = np.zeros(len(rows), dtype=np.int64)
        for c in keys:
            column = rows[c].combine_chunks()
            changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(changed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _BATCH:
                continue
            rows = pa.Table.from_batches(held)
            group = groups(rows)
            # The last name may go on in the next batch.
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from search(rows.slice(0, cut), group[:cut]).to_batches()
            held = rows.slice(cut).to_batches()
            # A name that fills batches is put together again only when it has doubled.
            size = 0 if len(rows) - cut >= _BATCH else len(rows) - cut
        if held:
            rows = pa.Table.from_batches(held)
            if len(rows):
                yield from search(rows, groups(rows)).to_batches()

    return run


def best_of_points(least: float, schema: pa.Schema):
    """Function for ``mapInArrow``: (ASKED) batches to the best match (FOUND) of each row."""
    return _in_groups(["name", "part"], lambda rows, group: _searched(rows, group, least, schema))


def best_of_groups(least: float, own: list[str], schema: pa.Schema):
    """Function for ``mapInArrow``: batches of the columns ``own`` and GROUPED, sorted by group,
    to the rows that ask with the columns ``own`` and their best match (BEST)."""
    return _in_groups(["_group"], lambda rows, group: _answered(rows, group, least, own, schema))
