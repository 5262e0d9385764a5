"""Runs of one recording in each user's plays, spelled alike or nearly so.

Per user the sequence is segmented optimally: a run costs the dissimilarity of its
plays to the spelling that represents it best, every run costs ``boundary`` besides,
and plays too unlike to share a representative can't share a run. The dynamic
programme is pruned twice: it runs only inside stretches of linked neighbours, as
any other boundary is forced, and over blocks of equal spelling; and a start that a
later start already beats is dropped for good, since the cost of a stretch is at
least that of its parts.

Plays are laid out by (user, week) and streamed in order, so that no task holds a
user. A stretch that may go on in the next week isn't segmented there: its blocks, a
row for each change of spelling, meet those of the next week and are segmented whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenloom.llm.recording import osa, parse_artist, parse_track, titles_alike, versions_alike
from listenloom.operators.intervals import DAY, slice_of
from listenloom.operators.usable import usable_plays
from listenloom.runtime import materialize

SLIP = 0.3
_FAR = 9.0
#: Counts of letters in which two names differ at most if a third is within two slips of both.
_APART = 8
_RUN = "user_id string, first_play_id bigint, last_play_id bigint, n_plays bigint, start_ts bigint, end_ts bigint, open boolean, joined boolean, artist_key string, title_key string, version_key string"
_RUN_ARROW = pa.schema([("user_id", pa.string()), ("first_play_id", pa.int64()), ("last_play_id", pa.int64()), ("n_plays", pa.int64()), ("start_ts", pa.int64()), ("end_ts", pa.int64()), ("open", pa.bool_()), ("joined", pa.bool_()), ("artist_key", pa.string()), ("title_key", pa.string()), ("version_key", pa.string())])
_CACHE = 300_000

Name = tuple[str, str, str]


def unlikeness(a: Name, b: Name) -> float:
    """0 for one spelling, ``SLIP`` for each slip of the pen, ``_FAR`` for other recordings."""
    if a == b:
        return 0.0
    slips = versions_alike(a[2], b[2])
    if slips > 1:
        return _FAR
    slips += titles_alike(a[1], b[1])
    if slips > 2:
        return _FAR
    artist = osa(a[0], b[0], 2)
    # two slips in the artist's name are believed where nothing else differs
    return SLIP * (slips + artist) if artist <= 1 and slips + artist <= 3 or artist == 2 and not slips else _FAR


def _frame(version: str) -> tuple:
    """What no slip changes in a version key: kinds, numbers of parts, and whether there are details."""
    return tuple((k, d if k == "part" else bool(d)) for k, _, d in (v.partition(":") for v in version.split("|")))


def _linkable(a: Name, b: Name) -> bool:
    """Whether some third spelling could be near both: it is within two slips of each in artist and in title, and a slip changes two counts of letters at most."""
    if a == b:
        return True
    if _frame(a[2]) != _frame(b[2]):
        return False
    return all((np.abs(np.diff(_letters([a[k], b[k]]), axis=0)).sum() <= _APART) for k in (0, 1))


def segment(names: list[Name], weights: list[int], boundary: float = 1.0) -> list[tuple[int, int]]:
    """Cheapest division of blocks (equal spelling, so many plays) into runs, as (start, end) pairs.

    Any spelling of the stretch may represent a run of it, as a slip may be all a run has.

    Pruned exact dynamic programme; of equally cheap divisions the one with fewest runs.
    """
    kinds = sorted(set(names))
    at = {k: i for i, k in enumerate(kinds)}
    d = np.array([[unlikeness(a, b) for b in kinds] for a in kinds])
    d[d >= _FAR] = np.inf
    n = len(names)
    best, since, runs = [0.0], [0], [0]
    sums: dict[int, np.ndarray] = {}  # start -> cost under each representative
    for j in range(n):
        sums[j] = np.zeros(len(kinds))
        cost, start = np.inf, j
        for i in sums:
            sums[i] = sums[i] + d[at[names[j]]] * weights[j]
            c = best[i] + float(sums[i].min()) + boundary
            if (round(c, 9), runs[i]) < (round(cost, 9), runs[start] if cost < np.inf else n + 1):
                cost, start = c, i
        best.append(cost)
        since.append(start)
        runs.append(runs[start] + 1)
        sums = {i: s for i, s in sums.items() if best[i] + float(s.min()) < cost - 1e-12}
    out, j = [], n
    while j:
        out.append((since[j], j))
        j = since[j]
    return out[::-1]


def _represented(names: list[Name], weights: list[int], boundary: float) -> Iterator[tuple[int, int, Name]]:
    """:func:`segment`, with the spelling among a run's own that represents it best."""
    for i, j in segment(names, weights, boundary):
        counts: dict[Name, int] = {}
        for m in range(i, j):
            counts[names[m]] = counts.get(names[m], 0) + weights[m]
        yield i, j, min(counts, key=lambda r: (sum(unlikeness(r, o) * c for o, c in counts.items()), r))


class _Names:
    """Keys of raw names, remembered; codes are valid for one batch."""

    def __init__(self):
        self.artists: dict[str, str] = {}
        self.tracks: dict[str, tuple[str, str]] = {}

    def artist(self, s: str) -> str:
        k = self.artists.get(s)
        if k is None:
            if len(self.artists) > _CACHE:
                self.artists.clear()
            k = self.artists[s] = parse_artist(s)
        return k

    def track(self, s: str) -> tuple[str, str]:
        k = self.tracks.get(s)
        if k is None:
            if len(self.tracks) > _CACHE:
                self.tracks.clear()
            k = self.tracks[s] = parse_track(s)[:2]
        return k


def _letters(keys: list[str]) -> np.ndarray:
    """Rows of letter counts; one slip changes two of them at most."""
    out = np.zeros((len(keys), 37), dtype=np.int16)
    flat = np.frombuffer("".join(keys).encode("ascii", "replace"), dtype=np.uint8)
    lengths = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    column = np.full(256, 36)
    column[ord("a") : ord("z") + 1] = np.arange(26)
    column[ord("0") : ord("9") + 1] = np.arange(26, 36)
    np.add.at(out, (np.repeat(np.arange(len(keys)), lengths), column[flat]), 1)
    return out


def _stretches(gap: int, boundary: float, week_seconds: int):
    """Runs of two plays and more of a partition sorted by user, week, ts, play_id, and the blocks of stretches that reach the ends of weeks."""

    def finish(rows: dict, names: _Names, fresh: bool, last: bool):
        """Runs of ``rows``, how many rows at the end aren't final, and whether those begin a week of a user.

        ``fresh``: whether the first row begins one. The last stretch is final only if ``last``.
        """
        n = len(rows["play_id"])
        users = rows["user_id"].dictionary_encode()
        u = np.asarray(users.indices)
        week, ts, ids = rows["week"], rows["ts"], rows["play_id"]
        ad, td = rows["artist"].dictionary_encode(), rows["track"].dictionary_encode()
        akeys = [names.artist(x) for x in ad.dictionary.to_pylist()]
        tkeys = [names.track(x) for x in td.dictionary.to_pylist()]
        au, ai = np.unique(np.array(akeys, dtype=object), return_inverse=True)
        tl = sorted(set(tkeys))
        tpos = {k: i for i, k in enumerate(tl)}
        ti = np.fromiter((tpos[k] for k in tkeys), dtype=np.int64, count=len(tkeys))
        a, t = ai[np.asarray(ad.indices)], ti[np.asarray(td.indices)]
        same = (u[1:] == u[:-1]) & (week[1:] == week[:-1])
        close = same & (ts[1:] - ts[:-1] <= gap)
        equal = close & (a[1:] == a[:-1]) & (t[1:] == t[:-1])
        maybe = np.flatnonzero(close & ~equal)
        link = equal.copy()
        if len(maybe):
            la, lt = _letters(list(au)), _letters([k[0] for k in tl])
            frames: dict[tuple, int] = {}
            lf = np.fromiter((frames.setdefault(_frame(k[1]), len(frames)) for k in tl), dtype=np.int64, count=len(tl))
            x, y = maybe, maybe + 1
            link[maybe] = (lf[t[x]] == lf[t[y]]) & (np.abs(la[a[x]] - la[a[y]]).sum(1) <= _APART) & (np.abs(lt[t[x]] - lt[t[y]]).sum(1) <= _APART)
        cut = np.flatnonzero(~link) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, n]
        upto = len(starts) if last else len(starts) - 1
        keep = 0 if last else n - int(starts[-1])
        new_group = np.r_[fresh, ~same]
        closing = np.r_[new_group[1:], last]
        edge = week.astype(np.int64) * week_seconds
        f, l = starts[:upto], ends[:upto] - 1
        opens = new_group[f] & (ts[f] - edge[f] <= gap)
        border = opens | (closing[l] & (edge[l] + week_seconds - ts[l] <= gap))
        blocks = np.flatnonzero(np.r_[True, ~equal])
        tops = np.r_[blocks[1:], n]
        of = np.searchsorted(starts, blocks, side="right") - 1
        single = np.bincount(of, minlength=len(starts))[:upto] == 1
        firsts, lasts, reps = [], [], []
        for k in np.flatnonzero(~border & ~single):
            lo, hi = np.searchsorted(of, [k, k + 1])
            spelled = [(au[a[x]], *tl[t[x]]) for x in blocks[lo:hi]]
            for i, j, rep in _represented(spelled, list(map(int, tops[lo:hi] - blocks[lo:hi])), boundary):
                if tops[lo + j - 1] - blocks[lo + i] > 1:
                    firsts.append(int(blocks[lo + i]))
                    lasts.append(int(tops[lo + j - 1]) - 1)
                    reps.append(rep)
        easy = ~border & single & (l > f)
        at = np.flatnonzero((of < upto) & border[np.minimum(of, max(upto - 1, 0))]) if upto else np.empty(0, dtype=np.int64)
        joined = (blocks[at] > starts[of[at]]) | opens[of[at]] if len(at) else np.empty(0, dtype=bool)
        fi = np.r_[f[easy], np.array(firsts, dtype=np.int64), blocks[at]].astype(np.int64)
        li = np.r_[l[easy], np.array(lasts, dtype=np.int64), tops[at] - 1].astype(np.int64)
        batch = None
        if len(fi):
            done, m = len(fi) - len(at), int(easy.sum())
            named = [reps[q - m] if m <= q < done else (au[a[i]], *tl[t[i]]) for q, i in enumerate(fi)]
            open_ = np.arange(len(fi)) >= done
            batch = pa.RecordBatch.from_arrays([rows["user_id"].take(pa.array(fi)), pa.array(ids[fi]), pa.array(ids[li]), pa.array(li - fi + 1), pa.array(ts[fi]), pa.array(ts[li]), pa.array(open_), pa.array(np.r_[np.zeros(done, dtype=bool), joined]), *[pa.array([r[k] for r in named], pa.string()) for k in range(3)]], schema=_RUN_ARROW)
        return batch, keep, bool(new_group[starts[-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, left, fresh = _Names(), None, True
        for b in batches:
            table = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            u, ids = table.column("user_id"), table.column("play_id")
            if table.num_rows > 1:  # deliveries of one play lie next to each other
                again = pc.and_(pc.equal(ids.slice(1), ids.slice(0, table.num_rows - 1)), pc.equal(u.slice(1), u.slice(0, table.num_rows - 1)))
                table = table.filter(pa.chunked_array([pa.array(np.r_[True, ~np.asarray(again)])]))
            table = table.combine_chunks()
            out, keep, fresh = finish(_columns(table), names, fresh, False)
            if out is not None:
                yield out
            left = table.slice(table.num_rows - keep)
        if left is not None and left.num_rows:
            out, _, _ = finish(_columns(left.combine_chunks()), names, fresh, True)
            if out is not None:
                yield out

    return run


def _columns(table: pa.Table) -> dict:
    def one(name):
        c = table.column(name)
        return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)

    return {k: one(k) if k in ("user_id", "artist", "track") else np.asarray(one(k)) for k in ("user_id", "week", "ts", "play_id", "artist", "track")}


def _stitch(gap: int, boundary: float):
    """Runs of stretches whose blocks come in the user's order; a block that isn't ``joined`` begins a stretch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = []  # blocks of one stretch: user, first, last, n, start, end, name
        out: list[tuple] = []

        def close() -> None:
            for i, j, rep in _represented([b[6] for b in held], [b[3] for b in held], boundary):
                n = sum(b[3] for b in held[i:j])
                if n > 1:
                    out.append((held[i][0], held[i][1], held[j - 1][2], n, held[i][4], held[j - 1][5], False, False, *rep))
            held.clear()

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                name = (r.artist_key, r.title_key, r.version_key)
                if held:
                    before = held[-1]
                    if before[0] == r.user_id and r.joined and r.start_ts - before[5] <= gap and _linkable(before[6], name):
                        if before[6] == name:
                            before[2], before[3], before[5] = r.last_play_id, before[3] + r.n_plays, r.end_ts
                            continue
                    else:
                        close()
                held.append([r.user_id, r.first_play_id, r.last_play_id, r.n_plays, r.start_ts, r.end_ts, name])
            if out:
                yield pd.DataFrame(out, columns=_RUN_ARROW.names)
                out.clear()
        if held:
            close()
        if out:
            yield pd.DataFrame(out, columns=_RUN_ARROW.names)

    return run


def repeated_runs(plays: DataFrame, gap: int = 1800, boundary: float = 1.0, week_seconds: int = 7 * DAY) -> DataFrame:
    """``user_id, first_play_id, last_play_id, n_plays, start_ts, end_ts, duration_s, artist_key, title_key, version_key``.

    Each longest stretch of two or more usable plays of one recording, neighbours at most
    ``gap`` seconds apart, in the user's order by ``ts``, then ``play_id``. ``duration_s``
    is from the first play's time to the last's. Plays that aren't usable (see
    :func:`usable_plays`) are as if they weren't there; a ``play_id`` delivered again, with
    the user and time it had, counts once. Plays in one second are ordered by id. An empty
    table gives no runs. ``week_seconds`` must be above ``gap``; it doesn't change results.
    """
    if week_seconds <= gap:
        raise ValueError("week_seconds must be above gap")
    rows = usable_plays(plays).select(F.col("user_id").cast("string").alias("user_id"), slice_of(F.col("ts"), week_seconds).alias("week"), F.col("ts").cast("bigint").alias("ts"), F.col("play_id").cast("bigint").alias("play_id"), "artist", "track")
    laid = rows.repartition("user_id", "week").sortWithinPartitions("user_id", "week", "ts", "play_id")
    runs = materialize(laid.mapInArrow(_stretches(gap, boundary, week_seconds), _RUN), "runs")
    inner = runs.where("not open")
    edges = runs.where("open").repartition("user_id").sortWithinPartitions("user_id", "start_ts", "first_play_id").mapInPandas(_stitch(gap, boundary), _RUN)
    return inner.unionByName(edges).select("user_id", "first_play_id", "last_play_id", "n_plays", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_s"), "artist_key", "title_key", "version_key")
