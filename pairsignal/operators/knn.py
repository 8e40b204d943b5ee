"""Exact nearest-neighbour join and decoding.

Vectors are grouped around pivots.  For every query group the pivot distances and the counts of training vectors
around each pivot give a radius that is sure to hold k neighbours; by the triangle inequality only training
vectors that can lie within it are sent to the group (Lu, Shen, Chen, Ooi: Efficient Processing of k Nearest
Neighbor Joins using MapReduce, 2012).  The number of pivots grows with the square root of the training vectors, and a
vector finds its pivot through a second, coarser level of them.  Equal vectors are collapsed before the search, so piles of copies cost
one comparison.  Groups are cut into bounded chunks; a task compares one query chunk with one training chunk and
keeps only the best k.  For a vote among very many neighbours no neighbour is listed at all: labels are counted
by similarity, the band around the k-th similarity is narrowed, and only that band is looked at one by one.

Two kinds of spaces need no pivots.  One whose training and query rows each fit one chunk is answered in one task, from one shuffle.
Where pivots prune too little (vectors of many dimensions) every query has to meet every training vector: there
the training chunks are copied to a number of query blocks that does not grow with the space, and a task lets the
chunks pass by its block and keeps the best k.  Votes are counted in these tasks.

Order of neighbours everywhere: similarity (rounded to ``SIM_DIGITS``) falling, then the smallest id that has the
vector, then id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.functions.chunks import is_whole, layout, map_chunks, map_spaces, matrix, pack, record, rows_of, summed
from pairsignal.functions.vectors import same_rows, unit, unit_rows
from pairsignal.operators.blocks import BLOCK, attach, block_of, largest, row_count, running_sums, spread_join
from pairsignal.session import settle

SPACE = ["pairing", "run_id"]
PIVOTS = 64           # pivots in one space up to which each stands for PER_PIVOT vectors; beyond, the square root of the vectors
PER_PIVOT = 256       # training vectors one pivot should stand for
FLAT = 256            # pivots that a vector is compared with one by one; more are grouped
ROUTED = 64           # query cells whose routes are found in one row
RINGS = 32            # distance steps in the count around a pivot
PIECE = 2048          # vectors in one chunk
SIM_DIGITS = 10       # similarities are ranked after rounding to this many decimals
SLACK = 1e-9
DEFAULT_K = 3
LIST_MOST = 1000      # neighbours up to which a vote lists them
BANDS = 64            # similarity bands counted in one pass, a power of two
PASSES = 3            # passes that narrow the band of the k-th neighbour
FIRSTS = 256          # copies of one vector in a block of its running label counts
LABELS = 65_536       # different labels up to which a label is a number in the tasks
DENSE = 8             # copies of every training vector from which on sending by pivots is given up
GRID = 48             # (query block, training slice) pairs of such a space
HELD = 1 << 22        # numbers a task holds for its query block
FEW = 16              # neighbours up to which the best of several slices are merged, and found one after the other
ROWS = 512            # queries compared with a training chunk at once


def _distinct(rows: DataFrame) -> DataFrame:
    """One row per distinct unit vector: ``vid`` is the smallest id that has it."""
    return rows.groupBy(*SPACE, "e").agg(F.min("t").alias("vid"))


def _choose_pivots(train: DataFrame, pivots: int = PIVOTS, flat: int = FLAT) -> DataFrame:
    """A hash sample of training vectors per space, as one flat array ``ps``, and the group of each pivot.

    More than ``flat`` pivots are grouped around the first of them, as many as the square root of their number.
    """
    size = train.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n_train"))
    wanted = F.least(F.ceil(F.col("n_train") / PER_PIVOT), F.greatest(F.lit(pivots), F.ceil(F.sqrt("n_train"))))
    wanted = settle(size.select(*SPACE, wanted.cast("bigint").alias("_most"), (wanted * 4 + 64).alias("_some"), "n_train"))
    # Only rows whose hash is among the smallest come before the window, some four times as many as are wanted.
    share = F.xxhash64("t") / F.lit(2.0**64) + 0.5
    few = attach(train, wanted, SPACE).filter(share * F.col("n_train") <= F.col("_some"))
    order = Window.partitionBy(*SPACE).orderBy(F.xxhash64("t"), "t")
    kept = few.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("_most"))
    # Copies of one vector make one pivot.
    distinct = kept.groupBy(*SPACE).agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("_r", "e"))).getField("e")).alias("_e"))
    flattened = distinct.select(*SPACE, F.size("_e").alias("n_pivots"), F.flatten("_e").alias("ps"))

    def group(row: dict) -> dict:
        n = row["n_pivots"]
        p = row["ps"].reshape(n, -1)
        heads = int(np.ceil(np.sqrt(n))) if n > flat else 1
        member = np.concatenate([_chord(p[i:i + PIECE], p[:heads]).argmin(axis=1) for i in range(0, n, PIECE)])
        member[:heads] = np.arange(heads)
        return {
            "pairing": [row["pairing"]], "run_id": [row["run_id"]], "n_pivots": [n], "ps": [row["ps"]],
            "grp": [member.astype(np.int32)], "n_numbers": [len(row["ps"]) + n],
        }

    return map_chunks(flattened, group, "pairing string, run_id int, n_pivots int, ps array<double>, grp array<int>, n_numbers int")


def _most(chosen: DataFrame) -> int:
    """The most pivots of any space."""
    return int(largest(chosen, "n_pivots") or 1)


def _nearest(e: np.ndarray, p: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A near pivot of every vector and the distance to it: the nearest one of the group whose first pivot is nearest."""
    heads = int(group.max()) + 1
    own = _chord(e, p[:heads]).argmin(axis=1) if heads > 1 else np.zeros(len(e), np.int64)
    cell, dist = np.empty(len(e), np.int32), np.empty(len(e))
    for g in np.unique(own):
        at, members = np.flatnonzero(own == g), np.flatnonzero(group == g)
        d = _chord(e[at], p[members])
        best = d.argmin(axis=1)
        cell[at], dist[at] = members[best], d[np.arange(len(at)), best]
    return cell, dist


def _to_pivots(vectors: DataFrame, pivots: DataFrame) -> DataFrame:
    """``vid, e`` with a near pivot ``cell`` and the distance ``dist`` to it."""
    hashed = vectors.withColumn("block", F.pmod(F.xxhash64("vid"), F.lit(1 << 40)))
    sizes = vectors.groupBy(*SPACE).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("bigint").alias("_parts"))
    parts = attach(hashed, sizes, SPACE, bound=pivots, spread="vid").withColumn("block", F.pmod("block", "_parts")).drop("_parts")
    chunks = attach(pack(parts, SPACE, order="vid", value="e"), pivots.select(*SPACE, "ps", "grp"), SPACE, bound=pivots, numbers=int(largest(pivots, "n_numbers") or 1), spread="block")

    def run(row: dict) -> dict:
        e = matrix(row)
        cell, dist = _nearest(e, row["ps"].reshape(-1, e.shape[1]), row["grp"])
        return {"pairing": row["pairing"], "run_id": row["run_id"], "vid": row["ts"], "cell": cell, "dist": dist, "e": e}

    return map_chunks(chunks, run, "pairing string, run_id int, vid bigint, cell int, dist double, e array<double>")


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows; on unit vectors the same order as cosine distance."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _routes(train: DataFrame, queries: DataFrame, pivots: DataFrame, k: int) -> DataFrame:
    """``pairing, run_id, cell, qcell, least``: training vectors of ``cell`` at least ``least`` from their pivot go to ``qcell``.

    ``most`` is a bound of their number.
    """
    ring = F.least(F.floor(F.col("dist") / 2.0 * RINGS), F.lit(RINGS - 1)).cast("int")
    rings = train.groupBy(*SPACE, "cell", ring.alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"))
    held = rings.groupBy(*SPACE).agg(F.sort_array(F.collect_list(F.struct("cell", "ring", "n", "far"))).alias("_t")).select(
        *SPACE, F.col("_t.cell").alias("tcell"), F.col("_t.n").alias("tn"), F.col("_t.far").alias("tfar")
    )
    reach = queries.groupBy(*SPACE, "cell").agg(F.max("dist").alias("reach"))
    some = F.floor(F.col("cell") / ROUTED).alias("block")
    asked = reach.groupBy(*SPACE, some).agg(F.sort_array(F.collect_list(F.struct("cell", "reach"))).alias("_q")).select(
        *SPACE, "block", F.col("_q.cell").alias("qcell"), F.col("_q.reach").alias("qreach")
    )

    def run(row: dict) -> dict:
        p = row["ps"].reshape(row["n_pivots"], -1)
        cells, begin = np.unique(row["tcell"], return_index=True)  # in order already
        farthest = np.maximum.reduceat(row["tfar"], begin)
        to, who, least, most = [], [], [], []
        of = np.searchsorted(cells, row["tcell"])
        for q, reach, between in zip(row["qcell"], row["qreach"], _chord(p[row["qcell"]], p)):
            upper = reach + between[row["tcell"]] + row["tfar"]
            order = np.argsort(upper)
            enough = np.searchsorted(np.cumsum(row["tn"][order]), k)
            radius = upper[order][enough] if enough < len(order) else np.inf
            lowest = between[cells] - reach - radius - SLACK
            near = farthest >= lowest
            to.append(cells[near])
            who.append(np.full(np.count_nonzero(near), q, np.int32))
            least.append(np.maximum(lowest[near], -1.0))
            most.append(np.add.reduceat(np.where(row["tfar"] >= lowest[of], row["tn"], 0), begin)[near])
        return {
            "pairing": row["pairing"], "run_id": row["run_id"], "cell": np.concatenate(to).astype(np.int32),
            "qcell": np.concatenate(who), "least": np.concatenate(least), "most": np.concatenate(most).astype(np.int64),
        }

    numbers = int(largest(pivots, "n_numbers") or 1) + 3 * RINGS * _most(pivots)
    known = attach(asked, pivots.join(held, SPACE), SPACE, bound=pivots, numbers=numbers, spread="block")
    return map_chunks(known, run, "pairing string, run_id int, cell int, qcell int, least double, most bigint")


def _pieces(rows: DataFrame, spaces: DataFrame, pivots: int, spread: tuple[str, ...] = ("vid",)) -> DataFrame:
    """Chunks of about ``PIECE`` rows per (space, cell); ``e`` may carry further numbers behind the vector."""
    sizes = rows.groupBy(*SPACE, "cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("bigint").alias("_parts"))
    sized = attach(rows, sizes, [*SPACE, "cell"], bound=spaces, numbers=4 * pivots, spread="vid")
    cut = sized.withColumn("piece", F.pmod(F.xxhash64(*spread), F.col("_parts")))
    return pack(cut, [*SPACE, "cell"], "piece", order="vid", value="e")


def _training_pieces(sent: DataFrame, spaces: DataFrame, pivots: int, spread: tuple[str, ...] = ("vid",)) -> DataFrame:
    pieces = _pieces(sent, spaces, pivots, spread)
    return pieces.select(*SPACE, "cell", F.col("piece").alias("tpiece"), F.col("ts").alias("tid"), F.col("xs").alias("tx"))


def _meet(left: DataFrame, right: DataFrame, spaces: DataFrame, pivots: int) -> DataFrame:
    """Every query chunk of a cell with every training chunk of it.

    The training chunk's number is part of the join key, so a hot cell is compared in many tasks.
    """
    counts = right.groupBy(*SPACE, "cell").agg((F.max("tpiece") + 1).alias("_n"))
    numbered = attach(left, counts, [*SPACE, "cell"], bound=spaces, numbers=4 * pivots, spread="piece")
    each = numbered.withColumn("tpiece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")
    return each.join(right, [*SPACE, "cell", "tpiece"])


def _send(placed: DataFrame, asking: DataFrame, chosen: DataFrame, k: int, pivots: int, routes: DataFrame | None = None) -> DataFrame:
    """Training vectors copied to every query group (``cell``) they may matter to."""
    routes = (_routes(placed, asking, chosen, k) if routes is None else routes).drop("most")
    return (
        attach(placed, routes, [*SPACE, "cell"], bound=chosen, numbers=5 * pivots * pivots, spread="vid")
        .filter(F.col("dist") >= F.col("least"))
        .select(*SPACE, F.col("qcell").alias("cell"), "vid", "e")
    )


def nearest_vectors(placed: DataFrame, asking: DataFrame, chosen: DataFrame, k: int, routes: DataFrame | None = None) -> DataFrame:
    """The k best distinct training vectors of every distinct query vector: ``pairing, run_id, qid, vid, sim``.

    Both sides come out of ``_to_pivots``.
    """
    pivots = _most(chosen)
    sent = _send(placed, asking, chosen, k, pivots, routes)
    right = _training_pieces(sent, chosen, pivots)
    left = _pieces(asking.select(*SPACE, "cell", "vid", "e"), chosen, pivots)

    def run(row: dict) -> dict:
        q, t = matrix(row), matrix(row, values="tx", order="tid")
        sims = np.round(q @ t.T, SIM_DIGITS)
        best = min(k, len(t))
        if best < len(t):
            # Everything above the k-th similarity, then the smallest ids among its equals.
            edge = -np.partition(-sims, best - 1, axis=1)[:, best - 1]
            tied = sims == edge[:, None]
            room = best - (sims > edge[:, None]).sum(axis=1)
            keep = (sims > edge[:, None]) | (tied & (np.cumsum(tied, axis=1) <= room[:, None]))
        else:
            keep = np.ones_like(sims, dtype=bool)
        at, hit = np.nonzero(keep)
        return {
            "pairing": row["pairing"], "run_id": row["run_id"], "qid": row["ts"][at], "vid": row["tid"][hit], "sim": sims[at, hit],
        }

    partial = map_chunks(_meet(left, right, chosen, pivots), run, "pairing string, run_id int, qid bigint, vid bigint, sim double")
    best = Window.partitionBy(*SPACE, "qid").orderBy(F.desc("sim"), "vid")
    return partial.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def nearest_neighbours(train: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """``pairing, run_id, qid, rank, nid, label, sim``: the k training rows most similar to each query row.

    ``train``: ``pairing, run_id, t, e, label``.
    """
    return _found(train, queries, k, pivots, voted=False)


def _found(train: DataFrame, queries: DataFrame, k: int | str, pivots: int, voted: bool) -> DataFrame:
    """The neighbours of every query row, or with ``voted`` the majority among them: ``pairing, run_id, qid, pred, votes``."""
    units = train.select(*SPACE, "t", "label", unit(F.col("e")).alias("e"))
    asked = queries.select(*SPACE, "t", unit(F.col("e")).alias("e"))
    names = _names(units)
    if names is None:
        return _ended(_by_pivots(units, asked, k, pivots), units, k, voted)
    sizes = _sizes(units, asked)
    fits = (F.col("n_train") <= PIECE) & (F.col("n_ask") <= PIECE)
    small, large = settle(sizes.filter(fits)), settle(sizes.filter(~fits))
    parts = []
    if row_count(small):
        parts.append(_in_one(_numbered(_within(units, small), names), _within(asked, small), k, voted, names))
    if row_count(large):
        parts.append(_large(_within(units, large), _within(asked, large), k, pivots, voted, names))
    if not parts:
        return _ended(_by_pivots(units, asked, k, pivots), units, k, voted)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _ended(listed: DataFrame, units: DataFrame, k: int | str, voted: bool) -> DataFrame:
    """Listed neighbours as they are wanted: the first ranks only, or their vote."""
    if k == "sqrt":
        sizes = settle(units.groupBy(*SPACE).agg(_root(F.count(F.lit(1))).alias("_k")))
        listed = attach(listed, sizes, SPACE, spread="qid").filter(F.col("rank") <= F.col("_k")).drop("_k")
    return vote(listed) if voted else listed


def _root(n: Column) -> Column:
    return F.floor(F.sqrt(n)).cast("int")


def _sizes(units: DataFrame, asked: DataFrame) -> DataFrame:
    """``n_train, n_ask`` of the spaces that have both."""
    n_train = units.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n_train"))
    return settle(n_train.join(asked.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n_ask")), SPACE))


def _within(rows: DataFrame, spaces: DataFrame) -> DataFrame:
    return attach(rows, spaces.select(*SPACE), SPACE, "left_semi", bound=spaces)


def _names(units: DataFrame) -> DataFrame | None:
    """The labels with their number in ascending order (``code``); None if they are many."""
    labels = settle(units.select("label").distinct())
    if row_count(labels) > LABELS:
        return None
    return settle(labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("code")))


def _numbered(units: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the number of their label instead of it."""
    known = F.broadcast(names.withColumnRenamed("label", "_label"))
    return units.join(known, F.col("label").eqNullSafe(F.col("_label"))).drop("label", "_label")


def _named(found: DataFrame, names: DataFrame, label: str) -> DataFrame:
    return found.join(F.broadcast(names.withColumnRenamed("label", label)), "code").drop("code")


def _majority(at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every number in ``at`` its most frequent code, the smaller one of a tie, and how often it occurs."""
    order = np.lexsort((codes, at))
    at, codes = at[order], codes[order]
    begin = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (codes[1:] != codes[:-1]))))[: len(at)]
    votes = np.diff(np.append(begin, len(at)))
    at, codes = at[begin], codes[begin]
    order = np.lexsort((codes, -votes, at))
    first = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))[: len(order)]]
    return at[first], codes[first], votes[first]


VOTED = "pairing string, run_id int, qid bigint, code bigint, votes bigint"


def _in_one(units: DataFrame, asked: DataFrame, k: int | str, voted: bool, names: DataFrame) -> DataFrame:
    """The answer for spaces whose training and query rows are one chunk each."""
    known = pack(units.withColumn("block", F.lit(0)), SPACE, value="e", extra=["code"])
    known = known.select(*SPACE, "block", F.col("ts").alias("tid"), F.col("xs").alias("tx"), F.col("code").alias("codes"))
    both = pack(asked.withColumn("block", F.lit(0)), SPACE, value="e").join(known, [*SPACE, "block"])

    def run(row: dict) -> dict:
        q, t = matrix(row), matrix(row, values="tx", order="tid")
        first, which = same_rows(t)
        place = np.lexsort((row["tid"], row["tid"][first][which]))  # smallest id of the vector, then id
        some, asks = same_rows(q)
        sims = np.round(q[some] @ t[first].T, SIM_DIGITS)[:, which[place]]
        best = min(len(t), int(np.sqrt(len(t))) if k == "sqrt" else k)
        if best <= FEW:
            hit = np.empty((len(some), best), np.int64)
            value, line = np.empty((len(some), best)), np.arange(len(some))
            for i in range(best):
                hit[:, i] = sims.argmax(axis=1)
                value[:, i] = sims[line, hit[:, i]]
                sims[line, hit[:, i]] = -np.inf
        else:
            hit = np.argsort(-sims, axis=1, kind="stable")[:, :best]
            value = np.take_along_axis(sims, hit, axis=1)
        nid, codes = row["tid"][place][hit], row["codes"][place][hit]
        space = {"pairing": row["pairing"], "run_id": row["run_id"]}
        if voted:
            _, code, votes = _majority(np.repeat(np.arange(len(some)), best), codes.ravel())
            return {**space, "qid": row["ts"], "code": code[asks], "votes": votes[asks]}
        return {
            **space, "qid": np.repeat(row["ts"], best), "rank": np.tile(np.arange(1, best + 1, dtype=np.int32), len(q)),
            "nid": nid[asks].ravel(), "code": codes[asks].ravel(), "sim": value[asks].ravel(),
        }

    if voted:
        return _named(map_chunks(both, run, VOTED), names, "pred").select(*SPACE, "qid", "pred", "votes")
    listed = map_chunks(both, run, "pairing string, run_id int, qid bigint, rank int, nid bigint, code bigint, sim double")
    return _named(listed, names, "label").select(*SPACE, "qid", "rank", "nid", "label", "sim")


def _first_k(q: np.ndarray, t: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """For every query the places of its k best training rows, by similarity and then place.

    ``t`` has every vector once, ``copies`` how many places in a row it takes.
    """
    sims = q @ t.T
    line, most = np.arange(len(q)), min(k, len(t))
    hit, value = np.empty((len(q), most), np.int64), np.empty((len(q), most))
    for i in range(most):
        hit[:, i] = sims.argmax(axis=1)
        value[:, i] = sims[line, hit[:, i]]
        sims[line, hit[:, i]] = -np.inf
    # Similarities are ranked after rounding: what may round up to the last one is looked at too.
    at, other = np.nonzero(sims >= (value[:, -1] - 10.0**-SIM_DIGITS)[:, None])
    who = np.concatenate([np.repeat(line, most), at])
    where = np.concatenate([hit.ravel(), other])
    order = np.lexsort((where, -np.round(np.concatenate([value.ravel(), sims[at, other]]), SIM_DIGITS), who))
    count = most + np.bincount(at, minlength=len(q))
    best = where[order[(np.cumsum(count) - count)[:, None] + np.arange(most)]]
    begin = np.cumsum(copies) - copies
    if copies.max() == 1:
        return begin[best]
    ends = np.cumsum(copies[best], axis=1)
    out = np.empty((len(q), min(k, int(copies.sum()))), np.int64)
    for i in range(out.shape[1]):
        which = (ends <= i).sum(axis=1)
        vector = best[line, which]
        out[:, i] = begin[vector] + i - (ends[line, which] - copies[vector])
    return out


def _decode_whole(embedded: DataFrame, k: int | str) -> DataFrame:
    """``decode`` of whole chunks: all their rows are queries, those before ``n_train`` the training rows."""

    def run(row: dict) -> dict | None:
        e = unit_rows(matrix(row, values="es"))
        n = int((row["ts"] < row["n_train"]).sum())
        best = min(n, int(np.sqrt(n)) if k == "sqrt" else k)
        if not best:
            return None
        some, asks = same_rows(e)
        # Times ascend, so vectors in the order of their first time, and their copies in time, are in the order of neighbours.
        _, first, which = np.unique(asks[:n], return_index=True, return_inverse=True)
        rank = np.argsort(first)
        place = np.argsort(np.argsort(rank)[which], kind="stable")
        if best <= FEW:
            hit = _first_k(e[some], e[first[rank]], np.bincount(which)[rank], best)
        else:
            sims = np.round(e[some] @ e[first].T, SIM_DIGITS)[:, which[place]]
            hit = np.argsort(-sims, axis=1, kind="stable")[:, :best]
        codes = row["label"][:n]
        names, coded = np.unique(codes, return_inverse=True)
        votes = np.bincount((np.arange(len(some))[:, None] * len(names) + coded[place][hit]).ravel(), minlength=len(some) * len(names))
        votes = votes.reshape(len(some), len(names))
        return {
            **{c: row[c] for c in SPACE}, "n_fit": n, "ts": [row["ts"]], "label": [row["label"]], "pred": [names[votes.argmax(axis=1)][asks]],
            "votes": [votes.max(axis=1)[asks]],
        }

    columns = embedded.select(*SPACE, "n_train", "ts", "es", "label")
    return map_spaces(columns, run, f"{layout(columns, *SPACE)}, n_fit bigint, ts binary, label binary, pred binary, votes binary")


def _dense(placed: DataFrame, routes: DataFrame) -> DataFrame:
    """Spaces in which pivots would send every training vector to many query groups."""
    n = placed.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("_n"))
    sent = routes.groupBy(*SPACE).agg(F.sum("most").alias("_sent"))
    return settle(n.join(sent, SPACE).filter(F.col("_sent") > DENSE * F.col("_n")).select(*SPACE))


def _large(units: DataFrame, asked: DataFrame, k: int | str, pivots: int, voted: bool, names: DataFrame) -> DataFrame:
    """The answer for other spaces: by pivots where these prune, by passing all training vectors where not."""
    top = k
    if k == "sqrt":
        top = int(units.groupBy(*SPACE).agg(_root(F.count(F.lit(1))).alias("_k")).agg(F.max("_k")).first()[0])
    chosen = settle(_choose_pivots(units, pivots))
    placed, asking = settle(_to_pivots(_distinct(units), chosen)), settle(_to_pivots(_distinct(asked), chosen))
    routes = settle(_routes(placed, asking, chosen, top))
    dense = _dense(placed, routes)
    if not row_count(dense) or top > LIST_MOST:
        return _ended(_by_pivots(units, asked, k, pivots, (chosen, placed, asking, routes)), units, k, voted)
    passed = _passed(_within(units, dense), _within(asked, dense), _within(placed, dense), _within(asking, dense), k, top, voted, names)
    if row_count(dense) == row_count(chosen):
        return passed
    rest = settle(chosen.select(*SPACE).join(dense, SPACE, "left_anti"))
    kept = [_within(x, rest) for x in (chosen, placed, asking, routes)]
    pruned = _by_pivots(_within(units, rest), _within(asked, rest), k, pivots, (settle(kept[0]), *kept[1:]))
    return passed.unionByName(_ended(pruned, _within(units, rest), k, voted))


def _by_pivots(units: DataFrame, asked: DataFrame, k: int | str, pivots: int, known: tuple | None = None) -> DataFrame:
    """Listed neighbours; ``known`` has the pivots, both sides' places and the routes, if they are there already."""
    if k == "sqrt":
        k = int(units.groupBy(*SPACE).agg(_root(F.count(F.lit(1))).alias("_k")).agg(F.max("_k")).first()[0] or 1)
    if known is None:
        chosen = settle(_choose_pivots(units, pivots))
        known = chosen, settle(_to_pivots(_distinct(units), chosen)), settle(_to_pivots(_distinct(asked), chosen)), None
    chosen, placed, wanted, routes = known
    found = nearest_vectors(placed, wanted, chosen, k, routes)
    # Only the k smallest ids of equal vectors can be among the k best.
    copies = (
        _copies(units, {}, k)
        .join(placed.select(*SPACE, "e", "vid"), [*SPACE, "e"])
        .select(*SPACE, "vid", F.col("t").alias("nid"), "label")
    )
    rank = Window.partitionBy(*SPACE, "qvid").orderBy(F.desc("sim"), "vid", "nid")
    per_vector = (
        found.withColumnRenamed("qid", "qvid")
        .join(copies, [*SPACE, "vid"])
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= k)
        .drop("vid")
    )
    return _answer(asked, wanted, per_vector).select(*SPACE, "qid", "rank", "nid", "label", "sim")


def _passed(units: DataFrame, asked: DataFrame, placed: DataFrame, asking: DataFrame, k: int | str, top: int, voted: bool,
            names: DataFrame) -> DataFrame:
    """The answer with every query vector compared with every training vector.

    A space is a grid of (query block, training slice); a task holds the queries of one block and lets the chunks of
    one slice pass.  The grid does not grow with the space unless a block's queries and their best would not fit a task.
    """
    width = int(asking.select(F.size("e").alias("_d")).limit(1).first()[0] if asking.limit(1).count() else 1)
    in_task = voted and top > FEW  # a vote needs no merging if a task sees all training vectors
    items = _numbered(_copies(units, {}, top), names).join(placed.select(*SPACE, "e", "vid"), [*SPACE, "e"])
    items = settle(items.select(*SPACE, "vid", "t", "code", "e"))
    many = _root(F.col("n_rows")) if k == "sqrt" else F.lit(k).cast("int")
    numbers = settle(
        items.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n"))
        .join(asking.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("nq")), SPACE)
        .join(units.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n_rows")), SPACE)
        .withColumn("_k", many)
        .withColumn("_held", F.ceil(F.col("nq") * (width + 4 * F.col("_k")) / HELD))
        # A training vector goes to every block and a query to every slice; a found row is as long as five numbers.
        .withColumn("_even", F.lit(GRID) if in_task else F.ceil(F.sqrt(GRID * F.col("nq") * (1 + F.lit(5 * top / width)) / F.col("n"))))
        .withColumn("blocks", F.least(F.greatest("_even", "_held", F.lit(1)), F.col("nq")).cast("bigint"))
        .withColumn("slices", F.lit(1) if in_task else F.least(F.ceil(F.lit(GRID) / F.col("blocks")), F.ceil(F.col("n") / PIECE)))
        .select(
            *SPACE, "_k", "blocks", F.col("slices").cast("bigint").alias("slices"),
            F.greatest(F.ceil(F.col("nq") / PIECE), "blocks").cast("bigint").alias("_q"), F.greatest(F.ceil(F.col("n") / PIECE), "slices").cast("bigint").alias("_t"),
        )
    )
    # All copies of a vector are in one chunk.
    piece = lambda rows, count: attach(rows, numbers.select(*SPACE, count), SPACE, bound=numbers, spread="vid").withColumn("piece", F.pmod(F.xxhash64("vid"), count)).drop(count)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    grid = numbers.select(*SPACE, "_k", "blocks", "slices")
    left = attach(pack(piece(asking.select(*SPACE, "vid", "e"), "_q"), SPACE, "piece", order="vid", value="e"), grid, SPACE, bound=grid, spread="piece")
    right = pack(piece(items, "_t"), SPACE, "piece", order="vid", value="e", extra=["t", "code"])
    right = attach(right, grid, SPACE, bound=grid, spread="piece")
    nothing = F.array().cast("array<bigint>")
    queries = left.select(
        *SPACE, F.pmod("piece", "blocks").alias("blk"), each("slices").alias("slice"), F.lit(0).alias("kind"), "_k",
        F.col("ts").alias("vid"), nothing.alias("id"), nothing.alias("code"), "xs",
    )
    training = right.select(
        *SPACE, each("blocks").alias("blk"), F.pmod("piece", "slices").alias("slice"), F.lit(1).alias("kind"), "_k",
        F.col("ts").alias("vid"), F.col("t").alias("id"), "code", "xs",
    )
    key = [*SPACE, "blk", "slice"]
    dealt = queries.unionByName(training).repartition(4 * GRID, *key).sortWithinPartitions(*key, "kind")
    ddl = VOTED if in_task else "pairing string, run_id int, qid bigint, vid bigint, nid bigint, code bigint, sim double"

    def compare(batches):
        at, held = None, None
        for batch in batches:
            for row in rows_of(batch):
                own = tuple(row[c] for c in key)
                if own != at:
                    if held is not None and len(held.ids):
                        yield record(held.voted() if in_task else held.listed(), ddl)
                    at, held = own, _Best(row["pairing"], row["run_id"], row["_k"])
                held.take(row)
        if held is not None and len(held.ids):
            yield record(held.voted() if in_task else held.listed(), ddl)

    found = dealt.mapInArrow(compare, ddl)
    if in_task:
        per_vector = _named(found, names, "pred").withColumnRenamed("qid", "qvid")
        return _answer(asked, asking, per_vector).select(*SPACE, "qid", "pred", "votes")
    best = F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("_s"), "vid", "nid", "code"))).alias("_b")
    merged = found.groupBy(*SPACE, F.col("qid").alias("qvid")).agg(best).select(*SPACE, "qvid", F.posexplode(F.slice("_b", 1, top)).alias("_i", "_n"))
    per_vector = _named(merged.select(
        *SPACE, "qvid", (F.col("_i") + 1).alias("rank"), F.col("_n.nid").alias("nid"), F.col("_n.code").alias("code"), (-F.col("_n._s")).alias("sim")
    ), names, "label")
    listed = _answer(asked, asking, per_vector).select(*SPACE, "qid", "rank", "nid", "label", "sim")
    return _ended(listed, units, k, voted)


class _Best:
    """The queries of one block and the best training rows that have passed so far."""

    def __init__(self, pairing: str, run: int, k: int):
        self.space, self.k = {"pairing": pairing, "run_id": run}, k
        self.ids, self.vectors = np.zeros(0, np.int64), None
        self.edge = np.zeros(0)
        self.found: list[tuple[np.ndarray, ...]] = []  # place of the query, similarity, vid, id, code
        self.waiting = 0

    def take(self, row: dict) -> None:
        vectors = row["xs"].reshape(len(row["vid"]), -1)
        if row["kind"] == 0:
            self.ids = np.concatenate([self.ids, row["vid"]])
            self.vectors = vectors.copy() if self.vectors is None else np.concatenate([self.vectors, vectors])
            self.edge = np.full(len(self.ids), -np.inf)
        elif len(self.ids):
            self._compare(row, vectors)

    def _compare(self, row: dict, vectors: np.ndarray) -> None:
        _, first, which = np.unique(row["vid"], return_index=True, return_inverse=True)
        for i in range(0, len(self.ids), ROWS):
            sims = self.vectors[i:i + ROWS] @ vectors[first].T
            if len(first) < len(which):
                sims = sims[:, which]
            low = self.edge[i:i + ROWS]
            if sims.shape[1] > self.k and np.isneginf(low).any():
                low = np.maximum(low, np.partition(sims, -self.k, axis=1)[:, -self.k])
            # The edge is rounded; what rounds up to it must not be missed.
            at, hit = np.nonzero(sims >= (low - 10.0**-SIM_DIGITS)[:, None])
            self.found.append((at + i, np.round(sims[at, hit], SIM_DIGITS), row["vid"][hit], row["id"][hit], row["code"][hit]))
            self.waiting += len(at)
        if self.waiting > max(2 * self.k * len(self.ids), PIECE):
            self._keep()

    def _keep(self) -> None:
        at, sim, vid, nid, code = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((nid, vid, -sim, at))
        count = np.bincount(at, minlength=len(self.ids))
        begin = np.cumsum(count) - count
        order = order[np.arange(len(at)) - np.repeat(begin, count) < self.k]
        self.found = [(at[order], sim[order], vid[order], nid[order], code[order])]
        full = np.flatnonzero(count >= self.k)
        ends = np.cumsum(np.minimum(count, self.k)) - 1
        self.edge[full] = sim[order][ends[full]]
        self.waiting = 0

    def listed(self) -> dict:
        if not self.found:
            self.found = [tuple(np.zeros(0, d) for d in (np.int64, float, np.int64, np.int64, np.int64))]
        self._keep()
        at, sim, vid, nid, code = self.found[0]
        return {**self.space, "qid": self.ids[at], "vid": vid, "nid": nid, "code": code, "sim": sim}

    def voted(self) -> dict:
        self.listed()
        at, code, votes = _majority(self.found[0][0], self.found[0][4])
        return {**self.space, "qid": self.ids[at], "code": code, "votes": votes}


def _answer(asked: DataFrame, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for each distinct query vector (``qvid``), for every query row that has the vector."""
    by_vector = found.join(wanted.select(*SPACE, "e", F.col("vid").alias("qvid")), [*SPACE, "qvid"])
    return spread_join(asked.withColumnRenamed("t", "qid"), by_vector, [*SPACE, "e"], "qid")


def _copies(units: DataFrame, sums: dict[str, Column], k: int) -> DataFrame:
    """The first k rows of every distinct vector by id, with their number ``_r`` and running ``sums``.

    Numbered in blocks of ids: a vector that a third of all rows share is no single window.
    """
    blocked = units.withColumn("block", block_of("t", BLOCK))
    numbered = running_sums(blocked, [*SPACE, "e"], {"_r": F.lit(1).cast("bigint"), **sums})
    return numbered.filter(F.col("_r") <= k).drop("block")


def vote(neighbours: DataFrame) -> DataFrame:
    """Majority label of each query; a tie goes to the smaller label: ``pairing, run_id, qid, pred, votes``."""
    counts = neighbours.groupBy(*SPACE, "qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    winner = counts.groupBy(*SPACE, "qid").agg(F.min(F.struct((-F.col("votes")).alias("_n"), F.col("label"))).alias("_w"))
    return winner.select(*SPACE, "qid", F.col("_w.label").alias("pred"), (-F.col("_w._n")).alias("votes"))


def decode(train: DataFrame, queries: DataFrame, k: int | str = DEFAULT_K, pivots: int = PIVOTS) -> DataFrame:
    """Majority label among the k nearest training rows: ``pairing, run_id, qid, pred, votes``.

    ``k='sqrt'`` takes the square root of each space's own number of training rows, rounded down.
    Whole chunks hold their training rows and queries together, with ``label``: both arguments are the same frame, and the
    result has ``pred`` and ``votes`` in the order of ``ts``, and the number of training rows as ``n_fit``.
    """
    if is_whole(queries):
        if train is not queries:
            raise ValueError("whole chunks hold their training rows themselves")
        return _decode_whole(queries, k)
    if k == "sqrt" or k <= LIST_MOST:
        return _found(train, queries, k, pivots, voted=True)
    return counted_vote(train, queries, k, pivots)


def counted_vote(train: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """As ``vote`` of ``nearest_neighbours`` without listing neighbours, for k in the tens of thousands and any labels."""
    units = train.select(*SPACE, "t", "label", unit(F.col("e")).alias("e"))
    asked = queries.select(*SPACE, "t", unit(F.col("e")).alias("e"))
    chosen = settle(_choose_pivots(units, pivots))
    placed, asking = settle(_to_pivots(_distinct(units), chosen)), settle(_to_pivots(_distinct(asked), chosen))
    routes = settle(_routes(placed, asking, chosen, k))
    codes, dense = (_names(units), _dense(placed, routes)) if k <= LIST_MOST else (None, None)
    if codes is None or not row_count(dense):
        return _counted(units, asked, placed, asking, chosen, routes, k)
    passed = _passed(_within(units, dense), _within(asked, dense), _within(placed, dense), _within(asking, dense), k, k, True, codes)
    if row_count(dense) == row_count(chosen):
        return passed
    rest = settle(chosen.select(*SPACE).join(dense, SPACE, "left_anti"))
    kept = [settle(_within(x, rest)) for x in (placed, asking, chosen, routes)]
    return passed.unionByName(_counted(_within(units, rest), _within(asked, rest), *kept, k))


def _counted(units: DataFrame, asked: DataFrame, placed: DataFrame, asking: DataFrame, chosen: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    names = placed.select(*SPACE, "e", "vid")
    counted = units.groupBy(*SPACE, "e", "label").agg(F.count(F.lit(1)).alias("n"))
    labelled = settle(counted.join(names, [*SPACE, "e"]).select(*SPACE, "vid", "label", "n"))
    sizes = labelled.groupBy(*SPACE, "vid").agg(F.sum("n").cast("double").alias("size"))
    pivots = _most(chosen)
    sent = _send(placed, asking, chosen, k, pivots, routes)
    right = settle(_training_pieces(
        sent.join(sizes, [*SPACE, "vid"]).withColumn("e", F.concat("e", F.array("size"))), chosen, pivots
    ))
    # The state of a query vector: the band [lo, hi) that holds its k-th neighbour, and the neighbours counted above it.
    start = F.array(F.lit(-1.5), F.lit(1.5), F.lit(0.0))
    state = _pieces(asking.select(*SPACE, "cell", "vid", F.concat("e", start).alias("e")), chosen, pivots)
    state = settle(state.select(*SPACE, "cell", "piece", "ts", "xs"))

    def parts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = matrix(row)
        return m[:, :-3], m[:, -3], m[:, -2], m[:, -1]

    def similar(row: dict, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similarities with the training rows, and the numbers behind their vectors."""
        t = matrix(row, values="tx", order="tid")
        return np.round(e @ t[:, : e.shape[1]].T, SIM_DIGITS), t[:, e.shape[1] :]

    def bands(row: dict):
        e, lo, hi, _ = parts(row)
        sims, size = similar(row, e)
        size = size[:, 0]
        at, hit = np.nonzero((sims >= lo[:, None]) & (sims < hi[:, None]))
        near, low, step = sims[at, hit], lo[at], ((hi - lo) / BANDS)[at]
        band = np.clip(np.floor((near - low) / step), 0, BANDS - 1)
        # With BANDS a power of two all edges are exact: compared with them, no similarity changes its band between passes.
        band = band - (near < low + band * step) + (near >= low + (band + 1) * step)
        sums = np.bincount(at * BANDS + band.astype(np.int64), weights=size[hit], minlength=len(e) * BANDS)
        yield (row["pairing"], row["run_id"], row["cell"], row["piece"]), sums

    def narrow(row: dict) -> dict:
        e, lo, hi, above = parts(row)
        counts = row["v"].reshape(len(e), BANDS)[:, ::-1]
        total = np.cumsum(counts, axis=1) + above[:, None]
        # The first band from the top that reaches k; the lowest one if all training rows are fewer.
        place = np.where((total >= k).any(axis=1), (total >= k).argmax(axis=1), BANDS - 1)
        passed = np.where(np.arange(BANDS)[None] < place[:, None], counts, 0).sum(axis=1)
        step = (hi - lo) / BANDS
        low = BANDS - 1 - place
        out = np.column_stack([e, lo + low * step, lo + (low + 1) * step, above + passed])
        return {
            "pairing": row["pairing"], "run_id": row["run_id"], "cell": row["cell"], "piece": [row["piece"]],
            "ts": [row["ts"]], "xs": [out.ravel()],
        }

    key = [*SPACE, "cell", "piece"]
    ddl = "pairing string, run_id int, cell int, piece bigint, ts array<bigint>, xs array<double>"
    for _ in range(PASSES):
        sums = summed(_meet(state, right, chosen, pivots), key, bands, "pairing string, run_id int, cell int, piece bigint")
        state = settle(map_chunks(state.join(sums, key), narrow, ddl))

    def rest(row: dict) -> dict | None:
        e, lo, hi, above = parts(row)
        sims, size = similar(row, e)
        size = size[:, 0]
        at, hit = np.nonzero((sims >= lo[:, None]) & (sims < hi[:, None]))
        if not len(at):
            return None
        order = np.lexsort((row["tid"][hit], -sims[at, hit], at))
        at, hit = at[order], hit[order]
        before = np.cumsum(size[hit]) - size[hit]
        before -= before[np.searchsorted(at, at)]
        keep = before < (k - above)[at]
        at, hit = at[keep], hit[keep]
        return {
            "pairing": row["pairing"], "run_id": row["run_id"], "qvid": row["ts"][at], "vid": row["tid"][hit],
            "sim": sims[at, hit], "size": size[hit],
        }

    def over(row: dict) -> dict | None:
        """Labels of the training rows above the band: sums per query vector and label."""
        e, _, hi, _ = parts(row)
        sims, tags = similar(row, e)
        at, hit = np.nonzero(sims >= hi[:, None])
        if not len(at):
            return None
        codes, which = np.unique((tags[:, 0].astype(np.int64) << 32) | tags[:, 1].astype(np.int64), return_inverse=True)
        sums = np.bincount(at * len(codes) + which[hit], weights=tags[hit, 2], minlength=len(e) * len(codes))
        slot = np.flatnonzero(sums)
        return {
            "pairing": row["pairing"], "run_id": row["run_id"], "qvid": row["ts"][slot // len(codes)],
            "code": codes[slot % len(codes)], "n": sums[slot].astype(np.int64),
        }

    def counts_above(row: dict) -> dict:
        return {"pairing": row["pairing"], "run_id": row["run_id"], "qvid": row["ts"], "above": parts(row)[3]}

    # A label travels among the numbers as the two halves of its hash.
    code = F.xxhash64("label")
    halves = [F.shiftright(code, 32).cast("double"), code.bitwiseAND((1 << 32) - 1).cast("double"), F.col("n").cast("double")]
    tagged = sent.join(labelled, [*SPACE, "vid"]).withColumn("e", F.concat("e", F.array(*halves)))
    by_label = _training_pieces(tagged, chosen, pivots, ("vid", "label"))
    above = map_chunks(_meet(state, by_label, chosen, pivots), over, "pairing string, run_id int, qvid bigint, code bigint, n bigint")
    labels = labelled.select("label", code.alias("code")).distinct()
    sure = above.groupBy(*SPACE, "qvid", "code").agg(F.sum("n").alias("n")).join(labels, "code").select(*SPACE, "qvid", "label", "n")

    candidates = map_chunks(
        _meet(state, right, chosen, pivots), rest, "pairing string, run_id int, qvid bigint, vid bigint, sim double, size double"
    )
    reached = map_chunks(state, counts_above, "pairing string, run_id int, qvid bigint, above double")
    along = Window.partitionBy(*SPACE, "qvid").orderBy(F.desc("sim"), "vid").rowsBetween(Window.unboundedPreceding, 0)
    taken = settle(
        candidates.withColumn("last", F.sum("size").over(along)).join(reached, [*SPACE, "qvid"])
        .withColumn("left", F.lit(float(k)) - F.col("above") - (F.col("last") - F.col("size"))).filter("left > 0")
    )
    whole = taken.filter("size <= left").join(labelled, [*SPACE, "vid"]).select(*SPACE, "qvid", "label", "n")
    # The vector at which k is reached may count in part only: its first copies by id.
    cut = taken.filter("size > left").select(*SPACE, "qvid", "vid", F.col("left").cast("bigint").alias("left"))
    firsts = _first_copies(units, names, cut.select(*SPACE, "vid", "left").distinct(), k)
    partly = cut.join(firsts, [*SPACE, "vid", "left"]).select(*SPACE, "qvid", "label", "n")
    totals = sure.unionByName(whole).unionByName(partly).groupBy(*SPACE, "qvid", "label").agg(F.sum("n").alias("votes"))
    winner = totals.groupBy(*SPACE, "qvid").agg(F.min(F.struct((-F.col("votes")).alias("_n"), F.col("label"))).alias("_w"))
    decided = winner.select(*SPACE, "qvid", F.col("_w.label").alias("pred"), (-F.col("_w._n")).alias("votes"))
    return _answer(asked, asking, decided).select(*SPACE, "qid", "pred", "votes")


def _first_copies(units: DataFrame, names: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``vid, left, label, n``: how many of the first ``left`` copies of a vector have each label.

    Whole blocks of copies come out of sums per block; only the last block of each ``left`` is listed.
    """
    block = F.floor((F.col("_r") - 1) / FIRSTS).cast("bigint")
    copies = settle(
        _copies(units, {}, k).join(names, [*SPACE, "e"]).join(wanted.select(*SPACE, "vid").distinct(), [*SPACE, "vid"], "left_semi")
        .select(*SPACE, "vid", "label", "_r", block.alias("copied"))
    )
    wanted = wanted.withColumn("copied", F.floor(F.col("left") / FIRSTS).cast("bigint"))
    sums = copies.groupBy(*SPACE, "vid", F.col("copied").alias("_b"), "label").agg(F.count(F.lit(1)).alias("n"))
    before = wanted.select(*SPACE, "vid", "copied").distinct().join(sums, [*SPACE, "vid"]).filter("_b < copied")
    before = before.groupBy(*SPACE, "vid", "copied", "label").agg(F.sum("n").alias("n"))
    lower = wanted.join(before, [*SPACE, "vid", "copied"]).select(*SPACE, "vid", "left", "label", "n")
    upper = wanted.join(copies, [*SPACE, "vid", "copied"]).filter("_r <= left")
    upper = upper.groupBy(*SPACE, "vid", "left", "label").agg(F.count(F.lit(1)).alias("n"))
    return lower.unionByName(upper)
