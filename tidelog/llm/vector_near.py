"""Near-duplicate vectors by product quantisation, without losing a link.

Vectors of unit length are dealt to coarse inverted lists; each is stored as codes of the subspaces
of its residual, with the length of what the codes miss. A pair of cosine at least t is at most
r = sqrt(2 - 2t) apart, from which three tests follow that no such pair fails:

* probes: x in list j is no farther from centroid j than from any other, and so than from any few
  others in the mean of squares. That difference is linear in x, so y within r of x passes it with a
  margin of 2r times the distance from centroid j to the few's mean. y is tested against its nearest
  one, two and four centroids, and must be no farther from centroid j than r and the list's radius;
* codes: the table-lookup distance from y to the coded x is at most r and what x's codes miss;
* the exact cosine, in double precision.

Lists are cut to blocks, and a task compares two blocks and returns counts and a spanning forest of
its links, so a group of any size costs rows in proportion to its vectors. Equal vectors count as
one with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, forest, gathered, hot_keys, sampled, split_join

BLOCK = 2048
_SLACK = 1e-5  # above the rounding of single precision in the tests; the cosine itself has none


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids (fewer if x has fewer rows) from evenly spread rows of x, by Lloyd's rounds."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        total, n = np.zeros_like(c, np.float64), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[a : a + 4096], c).argmin(1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    """Coarse centroids and codebooks of the residual's subspaces, for vectors of one length."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, codes: int) -> Index:
        coarse = _kmeans(x, lists)
        residual = x - coarse[_nearest(x, coarse)]
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int).tolist()
        return cls(coarse, [_kmeans(np.ascontiguousarray(residual[:, a:b]), codes) for a, b in zip(cuts, cuts[1:])], cuts)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a byte for each subspace) and the length of what they miss."""
        residual = x - self.coarse[at]
        codes = np.stack([_nearest(residual[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1)
        coded = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((residual - coded).astype(np.float64) ** 2).sum(1))

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to coded vectors of a list: tables by query and subspace, looked up and added."""
        residual = queries - self.coarse[cell]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            total += _squares(residual[:, a:b], book)[:, codes[:, i]]
        return np.sqrt(total)

    def probes(self, x: np.ndarray, at: np.ndarray, radii: np.ndarray, r: float) -> np.ndarray:
        """Which lists other than its own may hold a vector within r of each of x."""
        d2 = _squares(x, self.coarse)
        near = np.sqrt(d2) <= radii + r + _SLACK
        nearest = np.argsort(d2, 1)[:, :4]
        for few in (nearest[:, :m] for m in (1, 2, 4)):
            beyond = d2 - np.take_along_axis(d2, few, 1).mean(1)[:, None]
            gap = np.sqrt(_squares(self.coarse[few].mean(1), self.coarse) + _SLACK)
            near &= beyond <= 2 * r * gap + _SLACK
        near[np.arange(len(x)), at] = False
        return near


def _units(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.frombuffer(v, np.float64) for v in raw])
    return x, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", most_lists: int = 4096, per_list: int = 512, subspaces: int = 8, codes: int = 256, fit_rows: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """id, ``n_links``, ``component_id`` and ``kept`` of every row.

    Rows link if their labels are equal and not null, their vectors of equal length, and the cosine
    is at least the threshold. A vector that is null, empty, zero or holds null or non-finite
    components links with nothing: no links, its own component. Rows that repeat an id are rows of
    their own, and link. An empty table gives an empty result; other columns are not read.
    Centroids and codebooks are fitted on a bounded sample (``fit_rows``); every vector is indexed,
    and the tests lose no link, whatever the sample. The number of lists follows from how many
    vectors share a label with a vector in the mean, as only those are compared: about ``per_list``
    of a label are in a list. No label, list or group is capped.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("v"))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.coalesce(fine, F.lit(False))).withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64(F.lit(2), "v"))

    @F.arrow_udf("binary")
    def packed(v: pa.Array) -> pa.Array:
        return pa.array([np.array(x, np.float64).tobytes() for x in v.to_pylist()], pa.binary())

    # equal vectors of a label become one, where they are read; it is known by a number of its own, as ids may repeat
    same = ["label", "h1", "h2"]
    groups = valid.select("id", *same, F.size("v").alias("dim"), packed("v").alias("v")).groupBy(*same).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    groups = scratch.write(groups.withColumn("id", F.monotonically_increasing_id()))
    reps = groups.select("id", "label", "copies", "dim", "v")

    sizes = reps.groupBy("dim", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    dims = sizes.groupBy("dim").agg(F.sum("n").cast("long").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("peers")).collect()  # a row for each length of vector
    index = {}
    for dim, n, peers in dims:
        got = sampled(reps.where(F.col("dim") == dim).select("id", "v"), "id", fit_rows, 9, n).collect()
        raw = [bytes(r["v"]) for r in sorted(got, key=lambda r: (r["id"], bytes(r["v"])))] or [np.eye(1, dim).tobytes()]
        index[dim] = Index.fit(_units(raw)[1], int(min(most_lists, max(1, peers // per_list))), subspaces, codes)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, g in batch.groupby("dim"):
                ix = shared.value[dim]
                _, x = _units(g["v"].tolist())
                at = _nearest(x, ix.coarse)
                code, missed = ix.encode(x, at)
                far = np.sqrt(((x - ix.coarse[at]) ** 2).sum(1))
                yield g.assign(cell=at, far=far.astype(float), code=[c.tobytes() for c in code], missed=missed)

    placed = scratch.write(reps.mapInPandas(place, "id long, label string, copies long, dim int, v binary, cell long, far double, code binary, missed double"))
    radii = {(r["dim"], r["cell"]): r["far"] for r in placed.groupBy("dim", "cell").agg(F.max("far").alias("far")).collect()}  # a row for each list
    spread = {dim: np.array([radii.get((dim, c), -10.0) for c in range(len(ix.coarse))], np.float32) for dim, ix in index.items()}
    widths = spark.sparkContext.broadcast(spread)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold) + _SLACK))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, g in batch.groupby("dim"):
                _, x = _units(g["v"].tolist())
                at = g["cell"].to_numpy()
                near = shared.value[dim].probes(x, at, widths.value[dim], reach)
                near &= np.arange(near.shape[1])[None, :] < at[:, None]  # the pair is found in the list of the lower number
                i, j = np.nonzero(near)
                yield g.iloc[i].assign(cell=j)[["id", "label", "copies", "dim", "v", "cell"]]

    visits = placed.mapInPandas(visit, "id long, label string, copies long, dim int, v binary, cell long")
    place_of = ["label", "dim", "cell"]
    home = placed.groupBy(*place_of).agg(F.count(F.lit(1)).alias("nh")).withColumn("nh", F.ceil(F.col("nh") / BLOCK).cast("int"))
    guest = visits.groupBy(*place_of).agg(F.count(F.lit(1)).alias("nf")).withColumn("nf", F.ceil(F.col("nf") / BLOCK).cast("int"))
    blocks = home.join(guest, place_of, "left").fillna(0, ["nf"])
    own = placed.drop("far").join(blocks, place_of).withColumn("b", F.pmod(F.xxhash64("id"), F.col("nh")).cast("int"))
    task = F.explode(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda o: F.struct(F.lit(0).alias("kind"), F.least("b", o).alias("i"), F.greatest("b", o).alias("j"))),
            F.when(F.col("nf") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("nf"), F.lit(1)) - 1), lambda o: F.struct(F.lit(1).alias("kind"), o.alias("i"), F.col("b").alias("j")))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int>>")),
        )
    )
    own = own.withColumn("t", task).select(*place_of, "t.*", F.lit(True).alias("home"), "b", "id", "copies", "v", "code", "missed")
    come = visits.join(blocks, place_of).withColumn("b", F.pmod(F.xxhash64("id"), F.col("nf")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)))
    come = come.select(*place_of, F.lit(1).alias("kind"), F.col("b").alias("i"), "j", F.lit(False).alias("home"), "b", "id", "copies", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("missed"))

    def compare(group: pa.Table) -> pa.Table:
        kind, i, j, dim, cell = (group.column(c)[0].as_py() for c in ("kind", "i", "j", "dim", "cell"))
        g = group.select(["home", "b", "id", "copies", "v", "code", "missed"]).to_pandas().sort_values("id", kind="stable")
        if kind == 0:
            left, right = np.flatnonzero(g["b"] == i), np.flatnonzero(g["b"] == j)
        else:
            left, right = np.flatnonzero(~g["home"]), np.flatnonzero(g["home"])
        counts = np.zeros(len(g), np.int64)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            raw, x = _units(g["v"].tolist())
            norm, copies = np.linalg.norm(raw, axis=1), g["copies"].to_numpy()
            code = np.stack([np.frombuffer(c, np.uint8) for c in g["code"].iloc[right]])
            limit = (reach + g["missed"].to_numpy()[right]).astype(np.float32) + np.float32(10 * _SLACK)
            for a in range(0, len(left), 128):
                q = left[a : a + 128]
                close = shared.value[dim].distances(x[q], cell, code) <= limit
                if kind == 0 and i == j:
                    close &= right[None, :] > q[:, None]
                some = np.flatnonzero(close.any(1))
                cols = np.flatnonzero(close.any(0))
                if not len(cols):
                    continue
                q, y = q[some], right[cols]
                cosine = (raw[q] @ raw[y].T) / (norm[q][:, None] * norm[y][None, :])
                m, n = np.nonzero(close[np.ix_(some, cols)] & (cosine >= threshold))
                np.add.at(counts, q[m], copies[y[n]])
                np.add.at(counts, y[n], copies[q[m]])
                used = np.array(forest(len(g), q[m], y[n]), np.int64).reshape(-1, 2)
                us.append(used[:, 0])
                vs.append(used[:, 1])
        ids, hit = g["id"].to_numpy(), np.flatnonzero(counts)
        tree = np.array(forest(len(g), np.concatenate(us), np.concatenate(vs)), np.int64).reshape(-1, 2)
        return pa.table({
            "u": pa.array(np.concatenate([ids[hit], ids[tree[:, 0]]])),
            "v": pa.array(np.concatenate([ids[hit], ids[tree[:, 1]]])),
            "n": pa.array(np.concatenate([counts[hit], np.zeros(len(tree), np.int64)])),
        })

    found = scratch.write(own.unionByName(come).groupBy(*place_of, "kind", "i", "j").applyInArrow(compare, "u bigint, v bigint, n bigint"))
    count = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    comp = components(found.where("u != v").select("u", "v"), scratch).select(F.col("node").alias("rep"), "component")
    lows = comp.join(groups.select(F.col("id").alias("rep"), "low"), "rep")
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    total = groups.agg(F.sum("copies").alias("n")).first()["n"] or 0
    of_rep = split_join(comp, least.drop("n"), ["component"], gathered(hot_keys(least, ["component"], total)), ["rep"]).select("rep", "component_id")
    told = groups.select(F.col("id").alias("rep"), *same, "copies", "low").join(count, "rep", "left").join(of_rep, "rep", "left")
    told = scratch.write(told.select(*same, "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")))
    scratch.drop(groups, placed, found)
    own = F.col("id")
    linked = split_join(valid.select("id", *same), told.drop("copies"), same, gathered(hot_keys(told, same, total, "copies")), ["id"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"))
    kind = vectors.schema[id_col].dataType
    return linked.unionByName(alone).select(own.cast(kind).alias(id_col), "n_links", "component_id", F.coalesce(own == F.col("component_id"), F.lit(True)).alias("kept"))
