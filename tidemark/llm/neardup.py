"""MinHash near-duplicates with sequential Bayesian verification.

1. Each document gets the set of its word shingles (64-bit hashes), 128 minima of it, and a digest of its whole sequence of words.
   Documents with equal sequences are one class; equal sets of other sequences are links like any others.
2. Classes that share a band of four minima are candidates. First every class of a bucket is held against the bucket's
   smallest id; signatures are compared in batches, and a pair goes when the posterior probability that its similarity
   reaches the threshold falls below the chosen miss probability.
3. Survivors are verified on full sets of their texts' words, which are numbered and not hashed, and the links' components found.
4. Survivors also join classes to families. A family that still holds several components is laid out in cells of bounded size,
   two blocks of its classes each; a cell compares and verifies all pairs of different components, and gives only the links that join some.
5. In buckets that still hold several components, all pairs of different components and families are compared in cells of bounded
   size; a pair is reported by its first common band alone. Survivors are verified like the first ones, and components found again.

Pairs within a component are never made, nor are a family's pairs; texts move only for candidates, and no cap is set on a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, pick, tidy, work_folder, written
from tidemark.llm.graph import components
from tidemark.llm.textkernels import normal_bytes, numbered_shingles, shingle_set, word_hashes

MINIMA, BAND = 128, 4
BANDS, BATCH = MINIMA // BAND, 16
#: Percent of similarity from which documents are linked.
THRESHOLD = 75
MISS = 1e-5
#: Classes on a side of a cell in which a bucket's pairs are compared; pairs and shingles that one hub's group verifies.
CELL, GROUP_PAIRS, GROUP_SHINGLES = 256, 64, 200_000
#: Classes and shingles of a block of a family.
BLOCK, BLOCK_SHINGLES = 128, 400_000
#: Ids up to which those of candidates are broadcast to choose their texts; above, the join shuffles.
BROADCAST_IDS = 300_000
_GATHER = 200_000
#: Characters of partners' texts that are verified against a hub at a time.
_HELD_CHARS = 2_000_000


def _randoms() -> tuple[np.ndarray, np.ndarray]:
    make = np.random.default_rng(20)
    return make.integers(0, 1 << 63, MINIMA, dtype=np.uint64), make.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(threshold: int = THRESHOLD, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n minima a pair with fewer than m equal ones is given up.

    With a uniform prior, similarity given m of n equal is Beta(m + 1, n - m + 1), and the probability that it reaches t
    is that of at most m successes in n + 1 trials of chance t.
    """
    t, out = threshold / 100, []
    for n in range(BATCH, MINIMA + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def plausible(left: np.ndarray, right: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays survive all batches."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, least in limits:
        equal[alive] += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
        alive = alive[equal[alive] >= least]
    return alive


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, MINIMA)


def sketch(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (id, n, digest, signature); documents without words have no digest."""
    form = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, factor = _randoms()

        def rows(ids: list, sets: list[np.ndarray], digests: list[bytes | None]) -> pa.RecordBatch:
            full = [k for k, x in enumerate(sets) if len(x)]
            signatures: list[bytes | None] = [None] * len(sets)
            if full:
                flat, starts = np.concatenate([sets[k] for k in full]), np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
                minima = np.stack([np.minimum.reduceat((flat ^ r) * f, starts) for r, f in zip(salt, factor, strict=True)], axis=1)
                minima = (minima >> np.uint64(32)).astype("<u4")
                for k, x in zip(full, minima, strict=True):
                    signatures[k] = x.tobytes()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], schema=form)

        ids, sets, digests, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = normal_bytes(text.as_py() or "")
                ids.append(doc_id)
                sets.append(shingle_set(word_hashes(np.frombuffer(data, np.uint8))[0], size))
                digests.append(hashlib.blake2b(data, digest_size=16).digest() if data else None)
                held += len(sets[-1]) + 100
                if held > _GATHER:
                    yield rows(ids, sets, digests)
                    ids, sets, digests, held = [], [], [], 0
        if ids:
            yield rows(ids, sets, digests)

    return run


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, signature) to a row (band, key, id) for each band."""
    form = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("id", pa.int64())])
    place = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
    for batch in batches:
        if batch.num_rows:
            parts = _signatures(batch.column("signature")).reshape(-1, BANDS, BAND).astype(np.uint64)
            key = (parts * place).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
            key = (key ^ (key >> np.uint64(29))) * place[1]
            ids = np.repeat(batch.column("id").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), pa.array(key.view(np.int64).reshape(-1)), pa.array(ids)], schema=form)


def compare_pairs(limits: list[tuple[int, int]], threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, size_a, size_b, signature_a, signature_b) to the plausible (a, b, size_b)."""
    form = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size_a, size_b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
                alive = plausible(_signatures(batch.column("signature_a")), _signatures(batch.column("signature_b")), limits)
                alive = alive[100 * np.minimum(size_a, size_b)[alive] >= threshold * np.maximum(size_a, size_b)[alive]]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in form.names], schema=form)

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(c[low] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def compare_cells(limits: list[tuple[int, int]], threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Plausible pairs of different components in each cell (band, key, row, col), from its rows sorted by cell."""
    form = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, ["band", "key", "row", "col"]):
            part, ids, label, family, size = (cell.column(c).to_numpy() for c in ("part", "id", "label", "family", "n"))
            signature = _signatures(cell.column("signature"))
            row, col, band = (cell.column(c)[0].as_py() for c in ("row", "col", "band"))
            x, y = np.flatnonzero(part == row), np.flatnonzero(part == col)
            i, j = (z.reshape(-1) for z in np.meshgrid(x, y, indexing="ij"))
            wanted = (label[i] != label[j]) & (family[i] != family[j]) & (100 * np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]))
            if row == col:
                wanted &= i < j
            i, j = i[wanted], j[wanted]
            alive = plausible(signature[i], signature[j], limits)
            i, j = i[alive], j[alive]
            if len(i):
                same = (signature[i] == signature[j]).reshape(-1, BANDS, BAND).all(axis=2)
                own = same.argmax(axis=1) == band
                i, j = i[own], j[own]
                turn = ids[i] > ids[j]
                a, b = np.where(turn, j, i), np.where(turn, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(size[b])], schema=form)

    return run


def verify_cells(size: int, limits: list[tuple[int, int]], threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) that join components within each cell (family, row, col), from its rows with texts sorted by cell."""
    form = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, ["family", "row", "col"]):
            part, ids, label, n = (cell.column(c).to_numpy() for c in ("part", "id", "label", "n"))
            signature, text = _signatures(cell.column("signature")), cell.column("text")
            row, col = cell.column("row")[0].as_py(), cell.column("col")[0].as_py()
            i, j = (z.reshape(-1) for z in np.meshgrid(np.flatnonzero(part == row), np.flatnonzero(part == col), indexing="ij"))
            wanted = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
            if row == col:
                wanted &= i < j
            i, j = i[wanted], j[wanted]
            alive = plausible(signature[i], signature[j], limits)
            i, j = i[alive], j[alive]
            likely = np.argsort(-(signature[i] == signature[j]).sum(axis=1), kind="stable")
            wanted = np.unique(np.concatenate([i, j])).tolist()
            sets = dict(zip(wanted, numbered_shingles([text[k].as_py() or "" for k in wanted], size), strict=True))
            head: dict[int, int] = {}
            links = []

            def top(x: int, head: dict[int, int] = head) -> int:
                while head.get(x, x) != x:
                    x = head[x]
                return x

            for x, y in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
                p, q = top(int(label[x])), top(int(label[y]))
                if p == q:
                    continue
                if linked(sets[x], sets[y], threshold):
                    head[max(p, q)] = min(p, q)
                    links.append((int(ids[x]), int(ids[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], schema=form)

    return run


def linked(u: np.ndarray, v: np.ndarray, threshold: int) -> bool:
    """Whether two sets without repetitions are similar enough."""
    if threshold * max(len(u), len(v)) > 100 * min(len(u), len(v)):
        return False
    common = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * common >= threshold * (len(u) + len(v) - common)


def verify_sets(size: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) among rows (a, part, b, text) sorted by a and part; the hub's text comes first, with a null b."""
    form = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, others, held = None, [], [], 0

        def links() -> pa.RecordBatch:
            """Of the partners gathered so far, those of which some text links with one of the hub's."""
            sets = numbered_shingles([*own, *(text for _, text in others)], size)
            found = [b for (b, _), members in zip(others, sets[len(own) :], strict=True) if any(linked(x, members, threshold) for x in sets[: len(own)])]
            return pa.RecordBatch.from_arrays([pa.array([hub[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=form)

        for batch in batches:
            for a, part, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), batch.column("text"), strict=True):
                if others and (hub != (a, part) or held > _HELD_CHARS):
                    yield links()
                    others, held = [], 0
                if hub != (a, part):
                    hub, own = (a, part), []
                if b is None:
                    own.append(text.as_py() or "")
                else:
                    others.append((b, text.as_py() or ""))
                    held += len(others[-1][1])
        if others:
            yield links()

    return run


def texts_of(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(id, text) of the wanted ids, of which there are at most `most`; a text once for each id."""
    wanted = ids.distinct()
    if most <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "id", "left_semi").groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("id", "text")


def verified(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Those of the written (a, b, size_b) whose full sets reach the threshold. A hub's many partners are dealt to several groups."""
    spark = pairs.sparkSession
    texts = texts_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), 2 * pairs.count())
    parts = F.ceil(F.greatest(F.count("*") / F.lit(GROUP_PAIRS), F.sum("size_b") / F.lit(GROUP_SHINGLES)))
    hubs = pairs.groupBy("a").agg(F.greatest(parts, F.lit(1)).alias("parts"))
    dealt = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
    centres = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = members.union(centres).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(tidy(verify_sets(size, threshold)), "a long, b long")


def _cells(rows: DataFrame, side: F.Column, *columns: str) -> DataFrame:
    """Each row in all cells (row, col) with row <= col of which its part, one of `side` by a hash of id, is a side."""
    dealt = rows.select(*columns, F.pmod(F.xxhash64("id"), side).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), side - 1)).alias("other"))
    return dealt.select(*columns, "part", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= threshold * union of their sets of `size`-word shingles; with fewer words
    the whole sequence is the one shingle. Documents without words (null and empty ones too) have 0 shingles and are alone.
    Rows with one doc_id count as one document that has the links of each. A null doc_id is linked with
    nothing: its component is null and the row is kept. An empty table gives no rows; other columns are ignored.

    Candidates are found by 64-bit hashes of shingles, of which n_shingles is the number; links are confirmed on the words themselves,
    and only documents with the same words in the same order (by a 128-bit digest of all of them) count as equal unseen. Long texts
    are taken whole. At a similarity of 0.75 all 32 bands miss a link with a chance of 5e-6, and each of the eight batches with one of about `miss`.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    docs = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    limits = least_matches(threshold, miss)
    sketches = written(docs.mapInArrow(tidy(sketch(size)), "id long, n long, digest binary, signature binary"), folder, "sketches")
    classes = sketches.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes, folder, "classes")

    bands = classes.select("id", "signature").mapInArrow(tidy(band_keys), "band int, key long, id long")
    bands = written(bands, folder, "bands")
    heads = bands.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("m")).where("m > 1")
    members = written(bands.join(written(heads, folder, "heads"), ["band", "key"]).where("id > head").select("band", "key", "head", "m", "id"), folder, "members")

    discard(spark, folder, "bands", "heads")
    stars = written(members.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), folder, "stars")
    of = classes.select("id", "n", "signature")
    for end in "ab":
        stars = stars.join(of.select(F.col("id").alias(end), F.col("n").alias(f"size_{end}"), F.col("signature").alias(f"signature_{end}")), end)
    survivors = written(stars.mapInArrow(tidy(compare_pairs(limits, threshold)), "a long, b long, size_b long"), folder, "survivors-1")
    discard(spark, folder, "stars")
    links = written(verified(survivors, docs, size, threshold), folder, "links-1")
    labels = components(links, folder, "labels-1")

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    family = components(survivors, folder, "families").withColumnRenamed("label", "family")
    kin = written(family.join(labels, "id", "left").join(of, "id").select("family", "id", F.coalesce("label", "id").alias("label"), "n", "signature"), folder, "kin")
    mixed = kin.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.sum("n").alias("total")).where("low < high")
    mixed = written(mixed.select("family", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int").alias("side")), folder, "mixed-1")
    kin = written(kin.join(mixed, "family"), folder, "mixed-kin")
    kin = kin.join(texts_of(docs, kin.select("id"), kin.count()), "id")
    cells = _cells(kin, F.col("side"), "family", "id", "label", "n", "signature", "text").repartition(shuffles, "family", "row", "col").sortWithinPartitions("family", "row", "col")
    joined = written(cells.mapInArrow(tidy(verify_cells(size, limits, threshold)), "a long, b long"), folder, "links-2")
    if not joined.isEmpty():
        links = written(links.union(joined), folder, "links-12")
        labels = components(links, folder, "labels-2")
    discard(spark, folder, "survivors-1", "mixed-1", "kin", "mixed-kin")

    labelled = members.where("m > 2").join(labels, "id", "left").join(family, "id", "left")
    labelled = written(labelled.select("band", "key", "id", "m", F.coalesce("label", "id").alias("label"), F.coalesce("family", "id").alias("family")), folder, "labelled")
    mixed = labelled.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("family").alias("first"), F.max("family").alias("last")).where("low < high and first < last").select("band", "key")
    rest = labelled.join(written(mixed, folder, "mixed-2"), ["band", "key"])
    cells = _cells(rest, F.ceil(F.col("m") / CELL).cast("int"), "band", "key", "id", "label", "family").join(of, "id")
    cells = cells.repartition(shuffles, "band", "key", "row", "col").sortWithinPartitions("band", "key", "row", "col")
    survivors = written(cells.mapInArrow(tidy(compare_cells(limits, threshold)), "a long, b long, size_b long"), folder, "survivors-2")
    more = written(verified(survivors, docs, size, threshold), folder, "links-3")
    if not more.isEmpty():
        labels = components(written(links.union(more), folder, "links-123"), folder, "labels-3")

    found = written(classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component")), folder, "found")
    discard(spark, folder, "classes", "members", "families", "labelled", "mixed-2", "survivors-2", *(f"{name}-{k}" for name in ("links", "labels") for k in (1, 12, 123, 2, 3)))
    rows = sketches.select("id", "n", "digest").join(found, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    rows = rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
