"""Near-duplicate embeddings through a pivot-permutation index.

Every vector is described by its ``nearest`` closest reference points. Two
vectors that share at least ``shared`` of them meet in the inverted list of a
subset of that many pivots; there the pair's first shared subset decides which
list compares it, so each pair is verified once, in double precision.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from assay.llm.blocks import by_block, pairs_in_block, to_blocks
from assay.llm.common import arrow_stage, local_roots, stored
from assay.llm.graph import components

#: Reference points: this many vectors at most, whatever the input, taken from a
#: sample of ``SAMPLE``. No two are closer than ``APART`` (cosine), so a large
#: group of near copies gets one pivot and not many between which ranks waver.
PIVOTS = 256
SAMPLE = 2048
APART = 0.7


def _usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None where it can link with nothing."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    return v if v.size and np.isfinite(v).all() and v.any() else None


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def choose_pivots(vectors: DataFrame, embedding: str, number: int = PIVOTS) -> list[np.ndarray]:
    """At most ``number`` usable vectors in the order of a hash of their values,
    each at a distance from those before it."""
    sample = (
        vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0))
        .select(F.col(embedding).alias("v"))
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
        .select("v", F.xxhash64("v").alias("h"))
        .dropDuplicates(["h"])
        .orderBy("h")
        .limit(SAMPLE)
    )
    chosen: list[np.ndarray] = []
    for row in sample.collect():
        v = _usable(row["v"])
        if v is None or len(chosen) >= number:
            continue
        v = _unit(v)
        if all(len(p) != len(v) or p @ v < APART for p in chosen):
            chosen.append(v)
    return chosen


def _describe(pivots: list[np.ndarray], nearest: int, precision: str):
    """Batch step: class digest, vector bytes and the sorted nearest pivots."""
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(p) for p in pivots}:
        at = [i for i, p in enumerate(pivots) if len(p) == size]
        by_size[size] = np.array(at), np.array([pivots[i] for i in at])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels = batch.column("label").to_pylist()
        classes, data, places = [], [], []
        for label, vector in zip(labels, batch.column("embedding").to_pylist()):
            v = _usable(vector) if label is not None else None
            if v is None:
                classes.append(None), data.append(None), places.append(None)
                continue
            raw = v.astype(precision).tobytes()
            at, points = by_size.get(len(v), (np.empty(0, int), np.empty((0, len(v)))))
            # Nearest by cosine; equal distances go to the pivot with the smaller number.
            order = np.argsort(-(points @ _unit(v)), kind="stable")[:nearest]
            digest = xxhash.xxh3_64_intdigest(f"{label}:{len(v)}:".encode() + raw)
            classes.append(digest - (1 << 64) if digest >> 63 else digest)
            data.append(raw)
            places.append(np.sort(at[order]).tolist())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(classes, pa.int64()), batch.column("label"), pa.array(data, pa.binary()), pa.array(places, pa.list_(pa.int32()))],
            ["id", "class", "label", "vector", "places"],
        )

    return step


def _verify(threshold: float, shared: int, precision: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, first, place = np.unique(rows["class"].to_numpy(), return_index=True, return_inverse=True)
        vectors = [np.frombuffer(b, precision).astype(np.float64) for b in rows["vector"].iloc[first]]
        weight = rows["weight"].to_numpy()[first]
        width = max(map(len, vectors))
        unit = np.zeros((len(ids), width))
        for i, v in enumerate(vectors):
            unit[i, : len(v)] = _unit(v)
        deep = max(map(len, rows["places"]))
        places = np.full((len(ids), max(1, deep)), -1)
        for i, p in enumerate(rows["places"].iloc[first]):
            places[i, : len(p)] = p
        last_place = rows["last_place"].to_numpy()
        count = np.zeros(len(ids), np.int64)
        left, right = [], []

        def visit(i: np.ndarray, j: np.ndarray) -> None:
            a, b = place[i], place[j]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            i, a, b = i[near], a[near], b[near]
            if not len(a):
                return
            # Shared pivots up to the last of this list's subset: no others than the subset itself.
            pa_, limit = places[a], last_place[i]
            same = (pa_[:, :, None] == places[b][:, None, :]).any(axis=2) & (pa_ >= 0) & (pa_ <= limit[:, None])
            mine = same.sum(axis=1) <= np.minimum(shared, np.where(limit >= 0, shared, 0))
            a, b = a[mine], b[mine]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            left.append(a)
            right.append(b)

        pairs_in_block(rows["key"].to_numpy(), rows["chunk"].to_numpy(), rows["first_chunk"].to_numpy(), rows["last_chunk"].to_numpy(), visit)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        root = local_roots(len(ids), a, b)
        seen = count > 0
        return pd.DataFrame({"class": ids[seen], "links": count[seen], "root": ids[root[seen]]})

    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    row_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    pivots: int = PIVOTS,
    nearest: int = 6,
    shared: int = 3,
    chunk: int = 1024,
    rows_per_bin: int = 20_000,
) -> DataFrame:
    """``row_id``, ``n_links``, ``component_id``, ``kept`` for every row.

    Vectors link if their labels are equal and not null, their lengths are
    equal and their cosine is at least ``threshold``. Null, empty and zero
    vectors and those with null or non-finite components link with nothing.
    Equal vectors of a label count as links of each other but are compared with
    the rest once. Rows that repeat an id count as vectors of their own; rows
    without an id never name a component. Other columns are not read; an empty
    table gives no rows. Links are missed only where fewer than ``shared`` of
    the ``nearest`` pivots agree; a vector with fewer pivots of its length than
    that meets all others of its kind.
    """
    inner = vectors.schema[embedding].dataType.elementType.simpleString()
    precision = "<f4" if inner == "float" else "<f8"
    points = choose_pivots(vectors, embedding, pivots)
    label_type = vectors.schema[label].dataType.simpleString()
    id_type = vectors.schema[row_id].dataType.simpleString()
    rows = vectors.select(F.col(row_id).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    described = stored(
        arrow_stage(rows, f"id {id_type}, class bigint, label {label_type}, vector binary, places array<int>", _describe(points, nearest, precision)),
        "vectors",
    )
    weights = described.where("class is not null").groupBy("class").agg(F.count("*").alias("weight"), F.min("id").alias("low"))
    classes = stored(described.where("class is not null").select("class", "label", "vector", "places").dropDuplicates(["class"]).join(weights, "class"), "classes")

    def subsets() -> F.Column:
        chosen = [F.array(*[F.get("places", F.lit(i)) for i in c]) for c in combinations(range(nearest), shared)]
        full = F.filter(F.array(*chosen), lambda s: ~F.exists(s, lambda x: x.isNull()))
        return F.when(F.size(full) > 0, full).otherwise(F.array(F.array().cast("array<int>")))

    postings = classes.select(
        "class", F.xxhash64("label", F.octet_length("vector")).alias("kind"), F.explode(subsets()).alias("subset")
    ).select("class", F.xxhash64("kind", "subset").alias("key"), F.coalesce(F.try_element_at("subset", F.lit(-1)), F.lit(-1)).alias("last_place"))
    blocked = to_blocks(postings, ["key"], "class", chunk, rows_per_bin).join(classes.select("class", "vector", "places", "weight"), "class")
    found = stored(by_block(blocked, _verify(threshold, shared, precision), "class long, links long, root long"), "found")
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found, "class", "root").withColumnRenamed("node", "class").withColumnRenamed("component_id", "group")
    named = classes.select("class", "weight", "low").join(sums, "class", "left").join(groups, "class", "left").withColumn("group", F.coalesce("group", "class"))
    named = named.join(named.groupBy("group").agg(F.min("low").alias("component_id")), "group")
    named = stored(named.select("class", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
    return described.join(named, "class", "left").select(
        F.col("id").alias(row_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(row_id) == F.col("component_id"), F.lit(False)))
