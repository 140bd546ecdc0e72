"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its runs of five words. A shingle's weight is (1 + log tf) times
an inverse document frequency between 1 (in every document) and ``IDF_TOP`` (in at most
``IDF_FLOOR`` of them), so passages that much of the corpus shares count for less. Each of
BANDS * ROWS samples picks one shingle with the chance its weight gives it, and two texts
pick the same with the probability of their weighted Jaccard similarity. Texts that agree on
all samples of a band meet in a bucket, and meetings are verified on the whole texts. Weights
may not hide a pair that shares 0.8 of its shingles: the larger of the weighted and the plain
Jaccard similarity counts, and as many bands again are drawn from the plain sets, because
texts that repeat a passage often weigh it so much that they would not meet others by weight.

Exact copies are one node from the start, and every node is verified against one leader of
each bucket (the node that meets most others), so a group around a middle text takes one
comparison per node. Only nodes around one leader that this leaves in different components
are compared with each other, in blocks of bounded size and only where the triangle
inequality of the Jaccard distances leaves a link possible. Within a block, a matrix product
bounds all similarities from above and the pairs it leaves are verified one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.common import cut_narrow, type_of
from anchorlake.llm.components import components
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import (
    BLOCK_ROWS, blocks, mix, range_hashes, text_bytes, window_hashes, windows, words_of, worker_cache)
from anchorlake.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5   # a pair at 0.8 meets with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996
SEED = 20240607
DRAWS = 1 << 14       # random draws each sample chooses from by hash
CELLS = 1 << 16       # cells in which document frequencies are counted
IDF_FLOOR, IDF_TOP = 0.05, 1.2
BLOCK_NODES, BLOCK_TEXT = 512, 8 << 20  # nodes and bytes of text in one side of a block
_SLACK = 1e-6


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 56-bit identity and count of the distinct shingles of a block, in order."""
    words = words_of(data, offsets)
    at, text = windows(words.first, SHINGLE)
    ids = window_hashes(range_hashes(data, words.start, words.end), at, SHINGLE) if len(at) else np.zeros(0, np.uint64)
    keys = text.astype(np.uint64) << np.uint64(56) | ids >> np.uint64(8)
    keys.sort()
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> np.uint64(56)).astype(np.int64), keys & np.uint64((1 << 56) - 1), counts


def _cell(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(40)).astype(np.int64)


def idf_of_cells(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency for each cell of shingle identities, over all documents.

    The counters are as many at any size, and adding them up loses nothing. A cell's even
    share of all shingles is taken off its count, so what is left is due to frequent ones.
    """
    def count(batches):
        total, texts = np.zeros(CELLS, dtype=np.int64), 0
        for _, data, offsets in blocks(batches):
            _, ids, _ = shingles(data, offsets)
            total += np.bincount(_cell(ids), minlength=CELLS)
            texts += len(offsets) - 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], texts))], ["cell", "n"])

    sums = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sums.toPandas()  # at most CELLS + 1 rows
    texts = max(1, int(rows.loc[rows["cell"] < 0, "n"].sum()))
    counts = np.zeros(CELLS)
    cells = rows[rows["cell"] >= 0]
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    share = np.clip((counts - counts.sum() / CELLS) / texts, IDF_FLOOR, 1.0)
    return 1 + (IDF_TOP - 1) * np.log(1 / share) / np.log(1 / IDF_FLOOR)


def weights(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[_cell(ids)]


@worker_cache
def _sampler() -> tuple[np.ndarray, ...]:
    """For each sample: a hash multiplier and pools of r, log c and beta; and log a at IDF_TOP."""
    random = np.random.default_rng(SEED)
    samples = BANDS * ROWS
    factors = random.integers(0, 2**64, samples, dtype=np.uint64) | np.uint64(1)
    r = random.gamma(2.0, 1.0, (samples, DRAWS)).astype(np.float32)
    log_c = np.log(random.gamma(2.0, 1.0, (samples, DRAWS))).astype(np.float32)
    beta = random.random((samples, DRAWS), dtype=np.float32)
    usual = np.stack([_sortable(_log_a(np.float32(np.log(IDF_TOP)), *x)[0]) for x in zip(r, log_c, beta)])
    return factors, r, log_c, beta, usual


def _log_a(log_weight, r, log_c, beta):
    """The log of the value whose minimum is sampled, and the level t that goes with it."""
    level = np.floor(log_weight / r + beta)
    return log_c - r * (level - beta) - r, level


def _sortable(x: np.ndarray) -> np.ndarray:
    """32-bit floats as unsigned numbers in the same order."""
    bits = np.ascontiguousarray(x, dtype=np.float32).view(np.uint32)
    return np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31))


def band_keys(ids: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One key per text and band; ``first`` are the starts of the texts, none of them empty."""
    factors, r, log_c, beta, usual = _sampler()
    log_weight = np.log(weight).astype(np.float32)
    rare = np.flatnonzero(np.abs(weight - IDF_TOP) > 1e-9)
    place = np.arange(len(ids), dtype=np.uint64)
    keys = np.zeros((BANDS, len(first)), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        draw = (ids * factors[k] >> np.uint64(64 - DRAWS.bit_length() + 1)).astype(np.int32)
        value = usual[k][draw]
        if len(rare):
            d = draw[rare]
            value[rare] = _sortable(_log_a(log_weight[rare], r[k][d], log_c[k][d], beta[k][d])[0])
        best = np.minimum.reduceat(value.astype(np.uint64) << np.uint64(32) | place, first)
        at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        d = draw[at]
        level = _log_a(log_weight[at], r[k][d], log_c[k][d], beta[k][d])[1].astype(np.int64).astype(np.uint64)
        band = k // ROWS
        keys[band] = mix(keys[band] * np.uint64(0x9E3779B97F4A7C15) + mix(ids[at] + (level << np.uint64(56)))
                         + np.uint64(band + 1))
    return keys.T


@lru_cache(maxsize=1)
def _plain_factors() -> np.ndarray:
    """For each sample of the plain sets: a hash multiplier."""
    return np.random.default_rng([SEED, 1]).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def plain_band_keys(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One key per text and band, as ``band_keys``, where every shingle has the same weight."""
    keys = np.zeros((BANDS, len(first)), dtype=np.uint64)
    for k, factor in enumerate(_plain_factors()):
        least = np.minimum.reduceat(ids * factor, first)
        band = k // ROWS
        keys[band] = mix(keys[band] * np.uint64(0x9E3779B97F4A7C15) + mix(least) + np.uint64(BANDS + band + 1))
    return keys.T


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, key (of the exact text), bytes and bands; texts under five words have no bands."""
    def sign(batches):
        for block, data, offsets in blocks(batches, uses=(_sampler,)):
            text, ids, counts = shingles(data, offsets)
            some, first = np.unique(text, return_index=True)
            ends = np.zeros(block.num_rows + 1, dtype=np.int32)
            keys = np.zeros(0, dtype=np.int64)
            if len(some):
                keys = np.concatenate([band_keys(ids, weights(ids, counts, idf), first),
                                       plain_band_keys(ids, first)], axis=1).reshape(-1).view(np.int64)
                ends[some + 1] = 2 * BANDS
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("key"), pa.array(np.diff(offsets)),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys))],
                ["doc_id", "key", "bytes", "bands"])

    return keyed(docs).mapInArrow(
        sign, f"doc_id {type_of(docs, 'doc_id')}, key binary, bytes long, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key that equal texts share; null texts have no key."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def texts_of(keys: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """key and text of the given nodes; a document that occurs twice brings its text along twice."""
    wanted = nodes.select("key", "doc_id").join(keys, "key").withColumnRenamed("doc_id", "_first")
    return keyed(docs).join(wanted, "key").where(F.col("doc_id").eqNullSafe(F.col("_first"))).select("key", "text")


def _weighted_sets(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray):
    """Shingle keys (with the text number on top), their weights, and for each text the sum
    of its weights and its number of shingles."""
    text, ids, counts = shingles(data, offsets)
    w = weights(ids, counts, idf)
    texts = len(offsets) - 1
    return (text.astype(np.uint64) << np.uint64(56) | ids, w,
            np.bincount(text, w, minlength=texts), np.bincount(text, minlength=texts))


def _jaccard(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shared / np.maximum(a + b - shared, 1e-9)


def _with_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("similarity", F.greatest("weighted", "plain"))


def similarities(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b and the weighted and plain Jaccard similarity of the whole texts of each pair of nodes."""
    texts = texts_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), nodes, docs)
    side = lambda name: texts.select(F.col("key").alias(name), F.col("text").alias(f"text_{name}"))

    def compare(batches):
        for block, data, offsets in blocks(batches, "text_a"):
            keys_a, w_a, sum_a, size_a = _weighted_sets(data, offsets, idf)
            keys_b, w_b, sum_b, size_b = _weighted_sets(*text_bytes(block.column("text_b")), idf)
            keys, at_a, at_b = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
            pair = (keys >> np.uint64(56)).astype(np.int64)
            shared = np.bincount(pair, np.minimum(w_a[at_a], w_b[at_b]), minlength=block.num_rows)
            alike = np.bincount(pair, minlength=block.num_rows)
            yield pa.RecordBatch.from_arrays(
                [block.column("a"), block.column("b"), pa.array(_jaccard(shared, sum_a, sum_b)),
                 pa.array(_jaccard(alike, size_a, size_b))], ["a", "b", "weighted", "plain"])

    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return _with_similarity(both.mapInArrow(compare, "a binary, b binary, weighted double, plain double").groupBy(
        "a", "b").agg(F.max("weighted").alias("weighted"), F.max("plain").alias("plain")))


def _block_links(idf: np.ndarray, similarity: float):
    """Links between nodes of different components in one block of nodes around one leader."""
    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, w, sums, sizes = [], [], [], []
        for batch in rows.to_batches(max_chunksize=BLOCK_ROWS):
            data, offsets = text_bytes(batch.column("text"))
            keys, weight, total, size = _weighted_sets(data, offsets, idf)
            cut = np.searchsorted(keys >> np.uint64(56), np.arange(1, batch.num_rows))
            ids += np.split(keys & np.uint64((1 << 56) - 1), cut)
            w += np.split(weight, cut)
            sums.append(total)
            sizes.append(size)
        sums, sizes = np.concatenate(sums), np.concatenate(sizes)
        # shingles that only one node has share nothing
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        every, which, times = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        use = times[which] > 1
        owner, place, root = owner[use], column[which[use]], np.sqrt(np.concatenate(w)[use])
        bound, alike = (np.zeros((len(ids), len(ids)), dtype=np.float32) for _ in range(2))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            here = (place >= low) & (place < low + 4096)
            part = np.zeros((len(ids), 4096), dtype=np.float32)
            part[owner[here], place[here] - low] = root[here]
            bound += part @ part.T  # the geometric mean of two weights is at least their minimum
            part = (part > 0).astype(np.float32)
            alike += part @ part.T
        side, low, high = (rows[c].to_numpy() for c in ("part", "low", "high"))
        _, component = np.unique(np.array(rows["component"].to_pylist(), dtype="S16"), return_inverse=True)

        def possible(most: np.ndarray, totals: np.ndarray, measure: str) -> np.ndarray:
            near = rows[measure].to_numpy()
            return (most * (1 + similarity) >= similarity * (totals[:, None] + totals[None, :]) * (1 - 1e-5)) & (
                np.abs(near[:, None] - near[None, :]) <= 1 - similarity + _SLACK)

        open_pairs = possible(bound, sums, "weighted") | possible(alike, sizes, "plain")
        open_pairs &= component[:, None] != component[None, :]
        if low[0] != high[0]:
            open_pairs &= (side == low[0])[:, None] & (side == high[0])[None, :]
        else:
            open_pairs &= np.triu(np.ones_like(open_pairs), 1)
        found = []
        for a, b in zip(*np.nonzero(open_pairs)):
            _, at_a, at_b = np.intersect1d(ids[a], ids[b], assume_unique=True, return_indices=True)
            score = max(_jaccard(np.minimum(w[a][at_a], w[b][at_b]).sum(), sums[a], sums[b]),
                        _jaccard(len(at_a), sizes[a], sizes[b]))
            if score >= similarity:
                found.append((a, b, score))
        first, second, score = zip(*found) if found else ((), (), ())
        return pa.table({
            "a": rows["key"].take(pa.array(first, pa.int64())), "b": rows["key"].take(pa.array(second, pa.int64())),
            "similarity": pa.array(score, pa.float64())})

    return compare


def _meetings(nodes: DataFrame) -> DataFrame:
    """band, key and leader for every node that meets another one in a band."""
    placed = nodes.select("key", F.explode("bands").alias("band"))
    crowded = placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_narrow(placed.join(crowded, "band"))
    reach = met.groupBy("key").agg(F.sum("n").alias("reach"))
    leaders = met.join(reach, "key").groupBy("band").agg(
        F.max_by("key", F.struct("reach", "key")).alias("leader"))
    return cut_narrow(met.select("band", "key").join(leaders, "band"))


def links(nodes: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """a, b and similarity for links between different texts that join all texts linked at all."""
    met = _meetings(nodes)
    to_leader = cut_lineage(similarities(
        met.where("key != leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct(),
        nodes, docs, idf))
    found = to_leader.where(F.col("similarity") >= similarity)
    parts = components(found)
    # around each leader: how near every node is to it, and where the first links put it
    around = to_leader.select(F.col("a").alias("leader"), F.col("b").alias("key"), "weighted", "plain").join(
        nodes.select("key", "bytes"), "key").join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    mixed = around.groupBy("leader").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"),
        F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_TEXT)).cast("int").alias("parts"),
    ).where("_low != _high").select("leader", "parts")
    left = cut_narrow(around.join(mixed, "leader").withColumn(
        "part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    placed = left.join(texts_of(left.select("key").distinct(), nodes, docs), "key").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    more = placed.select(
        "leader", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "key",
        "component", "weighted", "plain", "text").groupBy("leader", "low", "high").applyInArrow(
        _block_links(idf, similarity), "a binary, b binary, similarity double")
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return found.select(least, most, "similarity").union(more.select(least, most, "similarity")).groupBy(
        "a", "b").agg(F.max("similarity").alias("similarity"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, exact_copies, n_links, keep.

    Documents belong to one class if they are equal or joined by links of Jaccard
    ``similarity`` or more; class_id is the least doc_id in it. exact_copies counts the rows
    with the same text, n_links the verified links of that text to different ones. keep marks
    the row to stay: the least doc_id of each class, and of rows equal in id and text the
    one that ``keep_one`` lets pass. Null texts equal nothing and form classes of their own;
    empty texts are equal to each other. Texts under five words only match when equal. A null
    doc_id never becomes a class id while the class has another. Other columns are ignored;
    an empty table gives an empty result.
    """
    idf = idf_of_cells(docs.select(F.col("text").cast("string").alias("text")).where("text is not null"))
    signed = cut_lineage(signatures(docs, idf))
    nodes = cut_lineage(signed.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"),
        F.first("bands").alias("bands")))
    linked = cut_narrow(links(nodes, docs, idf, similarity))
    degree = linked.select(F.col("a").alias("key")).union(linked.select("b")).groupBy("key").agg(
        F.count("*").alias("n_links"))
    parts = components(linked).withColumnRenamed("node", "key")
    placed = cut_narrow(nodes.drop("bands").join(parts, "key", "left").join(degree, "key", "left").select(
        "key", "doc_id", "copies", F.coalesce("component", "key").alias("component"),
        F.coalesce("n_links", F.lit(0)).alias("n_links")))
    classes = placed.groupBy("component").agg(
        F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"),
        F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("kept_key"))
    of_node = placed.join(classes, "component").select(
        "key", "class_id", "class_size", F.col("copies").alias("exact_copies"), "n_links",
        F.col("doc_id").alias("_first"), (F.col("key") == F.col("kept_key")).alias("_kept"))
    out = signed.drop("bands", "bytes").join(of_node, "key", "left")
    alone = F.col("key").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("exact_copies", F.lit(1)).alias("exact_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | (F.col("_kept") & F.col("doc_id").eqNullSafe(F.col("_first")))).alias("keep"), "key")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near duplicates, with all its columns; null texts all stay.

    Of rows equal in id and text, which stand for the same document, one stays.
    """
    kept = cut_narrow(near_duplicates(docs, similarity).where("keep").where("key is not null").groupBy(
        F.col("key").alias("_key"), F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows")))
    text = F.col("text").cast("string").cast("binary")
    whole = docs.select(F.struct("*").alias("row"), "doc_id", F.unhex(F.md5(text)).alias("key"))
    here = whole.join(kept, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    one = here.where("_rows = 1").select("row")
    twins = here.where("_rows > 1").groupBy("_key", "_id").agg(
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return one.union(twins).union(whole.where("key is null").select("row")).select("row.*")


@query("op10_near_duplicates")
def op10(t):
    return near_duplicates(t.documents).drop("key")
