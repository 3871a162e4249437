"""Near-duplicate documents by weighted MinHash over multisets of word shingles.

A shingle that occurs w times covers the weights [0, w). Each shingle has independent Poisson processes over the
dyadic weight levels [0, 1), [1, 2), [2, 4), [4, 8) ...: the level's points come in the order of their time, at a rate equal to the
level's width, each with a random signature slot and weight. A point counts for a text if its weight lies below w. A slot's value is the time of its
first point, so two texts agree in a slot with the probability of their weighted Jaccard similarity. A level is left as soon as its
next point comes later than the values of all slots.

Signatures are cut into bands; texts that share a band are candidates, and each pair that links is verified by the overlap of its
full multisets. Within a bucket each text is first compared with one hub. Groups that these links join need no further
pairs; texts of a bucket that are still in different groups are compared inside a task, which returns only links that join groups. So
no bucket is cut short and no large group of copies is expanded.

Defined results: a text without words (null, empty) links with nothing; texts with under five words count as one shingle, so they link
when their words agree. Texts with equal word sequences are one node. Repeated rows get equal results. An empty table gives
an empty result. component_id is the smallest doc_id of the group; a group of null doc_ids has null. kept is true for the group's smallest
(doc_id, id) and for texts without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelot.llm.common import cut, giving_back, texts
from wavelot.llm.links import across_links, components, star_pairs
from wavelot.llm.pieces import slices
from wavelot.llm.shingles import sequence_hashes, shingles
from wavelot.llm.hashing import mix

#: Signature slots: bands x rows. A pair of similarity 0.8 is missed with probability (1 - 0.8^5)^28 = 1.5e-5.
BANDS, ROWS = 28, 5


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Times of each slot's first point, n x slots; inf where a text has no element."""
    out = np.full((n, slots), np.inf)
    flat = out.reshape(-1)
    level = np.concatenate([np.zeros(len(element), np.int64), *[np.full(int((weight > 2 ** (k - 1)).sum()), k) for k in range(1, int(weight.max(initial=1)).bit_length() + 1)]])
    of = np.concatenate([np.arange(len(element)), *[np.flatnonzero(weight > 2 ** (k - 1)) for k in range(1, int(weight.max(initial=1)).bit_length() + 1)]])
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    begin = np.where(level > 0, width, 0.0)
    seed = mix(element[of] + mix(level.astype(np.uint64)))
    doc, most, time, point = text[of], weight[of], np.zeros(len(of)), 0
    while len(doc):
        # few active levels: several points of each at once
        step = max(1, min(64, 20_000 // len(doc)))
        r = np.arange(point, point + step, dtype=np.uint64)
        x = mix(seed[:, None] + r[None, :] * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log1p(-(x >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width[:, None]
        gap[:, 0] += time
        times = np.cumsum(gap, axis=1)
        y = mix(x)
        slot = ((y >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
        counts = begin[:, None] + (y & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[:, None] < most[:, None]
        at = (doc[:, None] * slots + slot)[counts]
        np.minimum.at(flat, at, times[counts])
        time, point = times[:, -1], point + step
        active = time < out.max(axis=1)[doc]
        doc, most, time, width, begin, seed = doc[active], most[active], time[active], width[active], begin[active], seed[active]
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as sorted hashes and multiplicities."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _sign(rows: DataFrame, size: int, bands: int, per_band: int) -> DataFrame:
    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, data = pdf["doc_id"].astype("Int64"), [(t or "").encode("utf-8", "replace") for t in pdf["text"]]
            for a, b in slices(data, 250_000):
                t, s, w, whole = shingles(data[a:b], size)
                sig = np.ascontiguousarray(signatures(t, s, w, b - a, bands * per_band)).view(np.uint64)
                band = np.zeros((b - a, bands), np.uint64)
                for k in range(per_band):
                    band = mix(band + sig[:, k::per_band])
                band = mix(band + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
                yield pd.DataFrame({"doc_id": ids.iloc[a:b].array, "id": pd.Series(whole.view(np.int64), dtype="Int64").where(whole != 0), "bands": list(band)})

    return rows.mapInPandas(run, "doc_id long, id long, bands array<long>")


def _multisets(rows: DataFrame, size: int) -> DataFrame:
    """rows: doc_id, text, id. The multiset of each row whose text has that id."""

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data, want = [(t or "").encode("utf-8", "replace") for t in pdf["text"]], pdf["id"].to_numpy()
            for a, b in slices(data, 250_000):
                t, s, w, whole = shingles(data[a:b], size)
                edges = np.searchsorted(t, np.arange(b - a + 1))
                good = np.flatnonzero(whole.view(np.int64) == want[a:b])
                yield pd.DataFrame({"id": want[a:b][good], "hashes": [s[edges[i] : edges[i + 1]].tobytes() for i in good], "counts": [w[edges[i] : edges[i + 1]].astype("<u4").tobytes() for i in good]})

    return rows.mapInPandas(run, "id long, hashes binary, counts binary")


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    @F.pandas_udf("double")
    def overlap(ha: pd.Series, ca: pd.Series, hb: pd.Series, cb: pd.Series) -> pd.Series:
        u8 = lambda x: np.frombuffer(x, "<u8")
        u4 = lambda x: np.frombuffer(x, "<u4")
        return pd.Series([similarity((u8(p), u4(q)), (u8(r), u4(s))) for p, q, r, s in zip(ha, ca, hb, cb, strict=True)], dtype="float64")

    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    judged = pairs.join(one, "a").join(two, "b").select("a", "b", overlap("ha", "ca", "hb", "cb").alias("similarity"))
    return judged.where(F.col("similarity") >= threshold).select("a", "b").distinct()


def near_copies(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = BANDS, per_band: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, component_id, kept (the one of its group that stays) and id, the hash of its words (null without words)."""
    rows = texts(docs, id_col, text_col)
    signed = cut(_sign(rows, size, bands, per_band))
    one_each = signed.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    distinct = cut(one_each)
    stars, crowded = star_pairs(distinct.select("id", F.col("bands").alias("keys")))
    stars = cut(stars)

    def prepare(pdf: pd.DataFrame):
        h = np.frombuffer(b"".join(pdf["hashes"]), "<u8")
        c = np.frombuffer(b"".join(pdf["counts"]), "<u4").astype(np.int64)
        sizes = np.fromiter((len(x) // 8 for x in pdf["hashes"]), np.int64, len(pdf))
        begin = np.cumsum(sizes) - sizes
        _, local = np.unique(h, return_inverse=True)
        total = np.add.reduceat(c, begin)
        weight = np.zeros(local.max() + 1, np.int64)

        def links_of(i: int, others: np.ndarray) -> np.ndarray:
            alike = np.minimum(total[others], total[i]) >= threshold * np.maximum(total[others], total[i])
            if not alike.any():
                return alike
            own = slice(begin[i], begin[i] + sizes[i])
            weight[local[own]] = c[own]
            both = np.add.reduceat(np.minimum(weight[local], c), begin)[others]
            weight[local[own]] = 0
            return alike & (both / (total[others] + total[i] - both) >= threshold)

        return links_of

    wanted = stars.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded.select("id")).distinct().join(distinct.select("id", F.col("doc_id").alias("rep")), "id")
    sets = cut(_multisets(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "text", "id"), size).dropDuplicates(["id"]).withColumn("size", F.octet_length("hashes") + F.octet_length("counts")))
    links = cut(_verify(stars, sets, threshold))
    groups = components(links)
    more = cut(across_links(crowded, groups, sets, prepare).select("a", "b").distinct())
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    named = signed.select("doc_id", "id").join(groups, F.col("id") == F.col("node"), "left").select("doc_id", "id", F.coalesce("component", "id").alias("component"))
    lowest = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id"), F.col("id"))).alias("first"))
    kept = F.when(F.col("component").isNull(), True).otherwise(F.struct(F.col("doc_id"), F.col("id")).eqNullSafe(F.col("first")))
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return named.join(lowest, "component", "left").select("doc_id", component_id.alias("component_id"), kept.alias("kept"), "id")


@F.pandas_udf(T.LongType())
@giving_back
def words_id(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The id that near_copies gives a text, null without words."""
    for batch in batches:
        data = [(t or "").encode("utf-8", "replace") for t in batch]
        whole = np.concatenate([np.zeros(0, np.uint64), *[sequence_hashes(data[a:b]) for a, b in slices(data, 250_000)]])
        yield pd.Series(whole.view(np.int64), dtype="Int64").where(whole != 0)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each group (its smallest doc_id) and all without words, with all their columns."""
    found = near_copies(docs, id_col=id_col, text_col=text_col, **options)
    keepers = found.where("kept and id is not null").select(F.col("id").alias("keep_id"), F.col("doc_id").alias("keep_doc")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(id_col).cast("long").alias("doc"), words_id(F.col(text_col).cast("string")).alias("words"))
    rows = rows.withColumn("at", F.coalesce("words", F.xxhash64("own")))  # rows without words spread out
    joined = rows.join(keepers, (F.col("at") == F.col("keep_id")) & F.col("doc").eqNullSafe(F.col("keep_doc")), "left")
    first = F.row_number().over(W.partitionBy("at", "doc").orderBy("at"))  # equal rows of one doc_id: one stays
    kept = joined.withColumn("n", first).where("words is null or (keep_id is not null and n = 1)")
    return kept.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])
