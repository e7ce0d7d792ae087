"""Joins between detections, tracklets and vectors: overlaps, cannot-link, neighbours, linkage, continuation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import geometry as G


#: Vectors a block of a matrix product.
BLOCK = 16_384


def box_pairs(d: DataFrame, key: list[str]) -> DataFrame:
    """a, b, iou, over_smaller of all pairs of detections that share key (a frame, whose number of faces is small)."""
    a = d.select(*key, F.col("det_id").alias("a"), F.col("box").alias("box_a"))
    b = d.select(*key, F.col("det_id").alias("b"), F.col("box").alias("box_b"))
    pairs = a.join(b, key).where("a < b")
    return pairs.select(*key, "a", "b", G.iou(F.col("box_a"), F.col("box_b")).alias("iou"), G.over_smaller(F.col("box_a"), F.col("box_b")).alias("over_smaller"))


#: Tracks a side of a map of all pairs of a video.
TRACKS = 1024


def cannot_link(d: DataFrame, video: str, frame: str, track: str, order: str, apart: float = 0.35) -> DataFrame:
    """video, a, b of tracks that are seen apart in a frame: either box null or an IoU below apart; each track's first detection of a frame counts.
    A video's tracks are dealt into blocks, and each pair of blocks marks its pairs in a map, frame by frame, in one task: a pair that is seen apart in many
    frames is one mark, and leaves the task once."""
    first = d.where(F.col(track).isNotNull()).groupBy(video, frame, track).agg(F.min_by("box", order).alias("box"))
    most = d.groupBy(video).agg(F.approx_count_distinct(track).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // TRACKS))
    kinds = dict(d.dtypes)
    sides = ("left", "top", "right", "bottom")
    dealt = first.where(F.col(video).isNotNull() & F.col(frame).isNotNull()).select(F.col(video).alias("video"), F.col(frame).alias("frame"), F.col(track).alias("track"), *[F.col("box")[c].alias(c) for c in sides], F.pmod(F.xxhash64(track), F.lit(blocks)).cast("int").alias("mine"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("ask", F.least("mine", "other")).withColumn("have", F.greatest("mine", "other")).drop("other")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(pdf):
        import pandas as pd

        x, y = pdf[pdf.mine == pdf.ask], pdf[pdf.mine == pdf.have]
        (ids_a, at_a), (ids_b, at_b) = (np.unique(side.track.to_numpy(), return_inverse=True) for side in (x, y))
        marked = np.zeros((len(ids_a), len(ids_b)), bool)
        corners = lambda side: [v.astype(np.int64) if v.dtype.kind == "i" else v for v in (side[c].to_numpy() for c in sides)]
        boxes_a, boxes_b, in_b = corners(x), corners(y), y.groupby("frame").indices
        for f, p in x.groupby("frame").indices.items():
            q = in_b.get(f)
            if q is not None:
                (l, t, r, b), (m, u, s, c) = ([e[p][:, None] for e in boxes_a], [e[q][None] for e in boxes_b])
                w, h = np.minimum(r, s) - np.maximum(l, m), np.minimum(b, c) - np.maximum(t, u)
                common = np.where((w > 0) & (h > 0), w * h, 0)
                union = (r - l) * (b - t) + (s - m) * (c - u) - common
                meet = (common > 0) & (union > 0)  # not so for a null box
                marked[at_a[p][:, None], at_b[q][None]] |= ~meet | (common.astype(float) / np.where(meet, union, 1).astype(float) < apart)
        if len(pdf) and pdf["ask"].iloc[0] == pdf["have"].iloc[0]:
            marked = np.triu(marked, 1)
        i, j = np.nonzero(marked)
        one, two = ids_a[i], ids_b[j]
        low = one < two
        return pd.DataFrame({"video": pdf.video.iloc[0], "a": np.where(low, one, two), "b": np.where(low, two, one)})

    found = dealt.repartition(parts, "video", "ask", "have").groupBy("video", "ask", "have").applyInPandas(run, f"video {kinds[video]}, a {kinds[track]}, b {kinds[track]}")
    return found.withColumnRenamed("video", video)


def knn(vectors: DataFrame, key: str, vector: str, k: int, blocks: int | None = None) -> DataFrame:
    """key, neighbour, rank, sim: the k nearest of each unit vector by cosine, itself left out, ties to the smaller id. Exact: vectors are dealt into
    blocks, and each pair of blocks is one matrix product in one task, of which only the k best a row leave it."""
    blocks = blocks or max(1, -(-vectors.count() // BLOCK))
    dealt = vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = dealt.select(F.col("block").alias("ask"), other.alias("have"), "id", "v", F.lit(True).alias("asking"))
    has = dealt.select(other.alias("ask"), F.col("block").alias("have"), "id", "v", F.lit(False).alias("asking"))

    def best(_, pdf):
        import pandas as pd

        q, c = pdf[pdf.asking], pdf[~pdf.asking].sort_values("id")
        if not len(q) or not len(c):
            return pd.DataFrame({"id": [], "neighbour": [], "sim": []}).astype({"id": "int64", "neighbour": "int64"})
        ids, out = c.id.to_numpy(), []
        x = np.stack(c.v.to_numpy())
        for start in range(0, len(q), 1024):
            part = q.iloc[start : start + 1024]
            sims = np.round(np.clip(np.stack(part.v.to_numpy()) @ x.T, -1, 1), 12)
            sims[part.id.to_numpy()[:, None] == ids[None, :]] = -2
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"id": np.repeat(part.id.to_numpy(), top.shape[1]), "neighbour": ids[top].ravel(), "sim": np.take_along_axis(sims, top, 1).ravel()}))
        found = pd.concat(out)
        return found[found.sim > -2]

    found = asks.unionByName(has).groupBy("ask", "have").applyInPandas(best, "id long, neighbour long, sim double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(key), "neighbour", "rank", "sim")


def knn_edges(neighbours: DataFrame, key: str, conflicts: DataFrame, least: float) -> DataFrame:
    """Neighbours similar enough that may link. conflicts(a, b), a < b."""
    pairs = neighbours.where(F.col("sim") >= least).withColumn("a", F.least(key, "neighbour")).withColumn("b", F.greatest(key, "neighbour"))
    return pairs.join(conflicts.select("a", "b"), ["a", "b"], "left_anti").select(key, "neighbour", "sim")


def strongest(edges: DataFrame, key: str, most: int = 16) -> DataFrame:
    """The most similar neighbours of each key, ties to the smaller id."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("sim"), "neighbour"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= most)


def linkage(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """a, b, members_a, members_b, sim: mean pairwise cosine of all groups' members, which for dot products is the dot product of the means; so
    one sum a group and component, and no pairs of vectors."""
    parts = vectors.select(group, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    a = means.select(F.col(group).alias("a"), "i", F.col("x").alias("xa"), F.col("n").alias("members_a"))
    b = means.select(F.col(group).alias("b"), "i", F.col("x").alias("xb"), F.col("n").alias("members_b"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.first("members_a").alias("members_a"), F.first("members_b").alias("members_b"), F.sum(F.col("xa") * F.col("xb")).alias("sim"))


def orphan_hosts(orphans: DataFrame, hosts: DataFrame, gap: int, max_drift: float = 1.5) -> DataFrame:
    """orphan, host: the first host (by start, then id) that ends or starts within gap of the orphan's start and lies where it goes on; else the orphan is its own.
    Both (video_id, id, start_us, end_us, first_box, last_box). A band join: hosts are filed under buckets of gap by their end, and looked up in three."""
    filed = hosts.select("video_id", F.floor(F.col("end_us") / gap).alias("bucket"), F.col("id").alias("host"), F.col("start_us").alias("host_start"), F.col("end_us").alias("host_end"), F.col("last_box").alias("host_box"))
    asked = orphans.select("video_id", "id", "start_us", "first_box", F.explode(F.array(*[F.floor(F.col("start_us") / gap) + k for k in (-1, 0, 1)])).alias("bucket"))
    near = asked.join(filed, ["video_id", "bucket"]).where((F.col("host") != F.col("id")) & (F.abs(F.col("start_us") - F.col("host_end")) <= gap) & G.continues(F.col("host_box"), F.col("first_box"), max_drift))
    first = near.groupBy("video_id", "id").agg(F.min_by("host", F.struct("host_start", "host")).alias("host"))
    return orphans.select("video_id", "id").join(first, ["video_id", "id"], "left").select("video_id", "id", F.coalesce("host", "id").alias("host"))


def suppress_overlaps(d: DataFrame, key: list[str], limit: float = 0.40) -> DataFrame:
    """The detections of each frame that greedy suppression keeps: by falling area, those that cover no kept box by more than limit of the smaller area.
    What is kept decides what goes, so a fold over the few boxes of a frame."""
    ordered = F.sort_array(F.collect_list(F.struct((-G.area(F.col("box"))).alias("by"), "det_id", "box")))
    fold = F.aggregate(ordered, F.filter(F.array(F.element_at(ordered, 1)), lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: G.over_smaller(y["box"], x["box"]) > limit), kept).otherwise(F.concat(kept, F.array(x))))
    return d.groupBy(*key).agg(fold.alias("kept")).select(*key, F.explode("kept").alias("x")).select(*key, F.col("x.det_id").alias("det_id"), F.col("x.box").alias("box"))


def _most_overlapping(a: np.ndarray, b: np.ndarray, least: float, empty: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each box of a (rows of left, top, right, bottom) the first box of b of the highest IoU, -1 where none reaches least, and that IoU. Boxes near each other
    in a are compared in blocks, with the boxes of b that are no farther than this IoU allows; an empty union needs areas that cancel, which are looked up."""
    (wa, ha), (wb, hb) = ((x[:, 2] - x[:, 0], x[:, 3] - x[:, 1]) for x in (a, b))
    area_a, area_b = wa * ha, wb * hb
    (xa, ya), (xb, yb) = (((x[:, 0] + x[:, 2]) / 2, (x[:, 1] + x[:, 3]) / 2) for x in (a, b))
    best, at = np.full(len(a), -np.inf), np.full(len(a), -1)
    asked, there = np.arange(len(a)), np.arange(len(b))
    if least > 0:  # boxes that meet none are out of it
        asked, there = np.flatnonzero((wa > 0) & (ha > 0)), np.flatnonzero((wb > 0) & (hb > 0))
    # an IoU of the areas is one of the widths and of the heights at most, and so bounds the distances of the centres
    share = (1 - least) / (1 + least) / 2 if least > 0 else np.inf
    slack = 1e-9 * max(1.0, float(np.nanmax(np.abs(a[asked]), initial=1.0)), float(np.nanmax(np.abs(b[there]), initial=1.0)))
    strips = max(1, round((len(asked) / 64) ** 0.5))
    strip = np.empty(len(asked), np.int64)
    strip[np.argsort(ya[asked], kind="stable")] = np.arange(len(asked)) * strips // max(1, len(asked))
    asked = asked[np.lexsort((xa[asked], strip))]
    for start in range(0, len(asked), 64):
        part = asked[start : start + 64]
        near = there
        if least > 0:
            dx, dy = ((most[part].max() + of[there]) * share + slack for most, of in ((wa, wb), (ha, hb)))
            x, y = xb[there], yb[there]
            near = there[(x >= xa[part].min() - dx) & (x <= xa[part].max() + dx) & (y >= ya[part].min() - dy) & (y <= ya[part].max() + dy)]
        for k in range(0, len(near), 4096):
            some = near[k : k + 4096]
            u, v = a[part][:, :, None], b[some].T[None]
            w = np.minimum(u[:, 2], v[:, 2]) - np.maximum(u[:, 0], v[:, 0])
            h = np.minimum(u[:, 3], v[:, 3]) - np.maximum(u[:, 1], v[:, 1])
            common = np.where((w > 0) & (h > 0), w * h, 0.0)
            union = area_a[part, None] + area_b[some] - common
            iou = np.divide(common, union, out=np.where(union == 0, -np.inf, 0.0), where=(common > 0) & (union > 0))
            first = iou.argmax(1)
            top = iou[np.arange(len(part)), first]
            better = (top >= least) & (top > best[part])
            best[part[better]], at[part[better]] = top[better], some[first[better]]
    value = np.inf if empty != empty else empty
    if value >= least and len(b):
        areas, first = np.unique(area_b, return_index=True)
        place = np.minimum(np.searchsorted(areas, -area_a), len(areas) - 1)
        better = np.isfinite(area_a) & (areas[place] == -area_a) & ((value > best) | (value == best) & (first[place] < at))
        best[better], at[better] = value, first[place][better]
        if empty != empty:
            best[best == np.inf] = empty
    return at, best


def best_overlap(wanted: DataFrame, found: DataFrame, key: list[str], least: float = 0.3, empty: float = 0.0) -> DataFrame:
    """det_id, match, iou: the detection of another resolution that overlaps each wanted box most, by at least this IoU; empty is that of an empty union
    (boxes of no area, or inverted ones whose negative area cancels the other's), and NaN counts as more than any. Rows come to a task in order of the key, and
    a frame at a time is compared in arrays: no row a pair of boxes."""
    sides = ("left", "top", "right", "bottom")
    known = F.col("box").isNotNull()
    for c in key:
        known = known & F.col(c).isNotNull()
    side = lambda d, n: d.where(known).select(*key, F.lit(n).alias("_side"), F.col("det_id").alias("_id"), *[F.col("box")[c].cast("double").alias(f"_{c}") for c in sides])
    rows = side(wanted, 0).unionByName(side(found, 1)).repartition(*key).sortWithinPartitions(*key, "_side", F.asc_nulls_last("_id"))

    def compared(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        changes = lambda names: np.logical_or.reduce([pc.fill_null(pc.not_equal(table[c][1:], table[c][:-1]), True).to_numpy() for c in names])
        boxes = np.stack([table[f"_{c}"].to_numpy() for c in sides], 1)
        frame = np.r_[0, np.flatnonzero(changes(key)) + 1, len(table)]
        mine = np.r_[0, np.cumsum(table["_side"].to_numpy() == 0)]
        at, best = np.full(len(table), -1), np.zeros(len(table))
        for start, end in zip(frame[:-1].tolist(), frame[1:].tolist(), strict=True):
            middle = start + int(mine[end] - mine[start])
            if start < middle < end:
                place, best[start:middle] = _most_overlapping(boxes[start:middle], boxes[middle:end], least, empty)
                at[start:middle] = np.where(place < 0, -1, place + middle)
        # of rows of one id, which stand together, the best counts
        one = np.r_[0, np.cumsum(changes([*key, "_side", "_id"]))]
        got = np.flatnonzero(at >= 0)
        got = got[np.lexsort((at[got], -np.nan_to_num(best[got], nan=np.inf), one[got]))]
        got = got[np.r_[True, one[got][1:] != one[got][:-1]]] if len(got) else got
        return pa.RecordBatch.from_arrays([*[table[c].take(got).combine_chunks() for c in key], table["_id"].take(got).combine_chunks(), table["_id"].take(at[got]).combine_chunks(), pa.array(best[got])], names=[*key, "det_id", "match", "iou"])

    def run(batches: Iterator):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last frame goes on, for all that is known
            last = {c: batch[c][batch.num_rows - 1] for c in key}
            same = np.logical_and.reduce([pc.equal(batch[c], last[c]).to_numpy(zero_copy_only=False) for c in key])
            begins = int(same.argmax())
            if held and (begins or any(held[-1][c][held[-1].num_rows - 1] != last[c] for c in key)):
                yield compared(pa.Table.from_batches([*held, batch.slice(0, begins)]))
                held = []
            elif begins:
                yield compared(pa.Table.from_batches([batch.slice(0, begins)]))
            held.append(batch.slice(begins))
        if held:
            yield compared(pa.Table.from_batches(held))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + f", det_id {kinds['_id']}, match {kinds['_id']}, iou double"
    return rows.mapInArrow(run, schema).select(*key, F.col("det_id").cast(dict(wanted.dtypes)["det_id"]), F.col("match").cast(dict(found.dtypes)["det_id"]), "iou")


def usable_or_all(rows: DataFrame, key: list[str], keep: Column) -> DataFrame:
    """Of each key the rows that keep holds for, or all where it holds for none."""
    good = F.coalesce(keep, F.lit(False))
    return rows.withColumn("_good", good).withColumn("_any", F.max("_good").over(W.partitionBy(*key))).where("_good or not _any").drop("_good", "_any")


def crop_plans(d: DataFrame, key: list[str], frame_width: int, frame_height: int) -> DataFrame:
    """key, det_id, crop, is_clean, coverage: a portrait crop around each face that leaves out its neighbours in the frame."""
    from sightline.operators.crops import plan_crop

    names = [*key, "det_id"]
    grouped = d.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("det_id", "box"))).alias("faces"))

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for *at, faces in pdf[[*key, "faces"]].itertuples(index=False):
                boxes = [tuple(f["box"][c] for c in ("left", "top", "right", "bottom")) for f in faces]
                for f, own in zip(faces, boxes, strict=True):
                    crop, clean, cover = plan_crop(own, boxes, frame_width, frame_height)
                    rows.append((*at, f["det_id"], *crop, clean, cover))
            yield pd.DataFrame(rows, columns=[*names, "left", "top", "right", "bottom", "is_clean", "coverage"])

    kinds = dict(d.dtypes)
    return grouped.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", left int, top int, right int, bottom int, is_clean boolean, coverage double")
