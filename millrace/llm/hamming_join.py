"""Near duplicates by a multi-index Hamming join over b-bit minwise signatures.

A document is the set of its distinct word n-grams. Equal sets are one class, named
by its smallest id. A class has a signature of POSITIONS minima, b bits each; two
sets of similarity s differ in each position with probability 1 - s. DISTANCE is the
number of positions in which a pair at the similarity threshold differs in less than
about one of 5,000 cases more.

Pigeonhole: of CHUNKS chunks of the signature, one has at most DISTANCE // CHUNKS
errors, so keys that enumerate which positions of a chunk are in error find every
pair within DISTANCE. Keys with one member are dropped. Then

1. each member of a key is compared with the key's smallest member, on full sets;
2. in keys whose members are still in different components, all pairs from different
   components are compared block by block, by signature and then on full sets, so
   that no pair is emitted but the links found.

Every pair of a key is thus either compared, or already in one component. Nothing is
capped or sampled.

Definitions for odd input: a null or empty text, or one without words, has no set
(n_shingles 0) and is linked with nothing; a text of fewer than n words has one
shingle, its whole sequence; rows sharing an id are one document, whose links are
those of all of its rows; a row with a null id is kept and linked with nothing; texts of
any length are compared whole; an empty table gives an empty result; further columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, likely, session_of, unlikely
from millrace.llm.components import components

POSITIONS, CHUNKS, DISTANCE, SEED = 64, 13, 25, 11
#: Low bits of a key that tell its place in the index.
SLOT_BITS = 12
#: Most documents and shingles of a block, on average.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 400_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of the words of the text in lower case (A-Z only)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        grams = (grams ^ (grams >> np.uint64(31))) * _MIX + h[k : len(h) - n + 1 + k]
    grams ^= grams >> np.uint64(32)
    grams *= _STEP
    return np.unique(grams)


class Signer:
    def __init__(self, positions: int):
        draw = np.random.default_rng(SEED)
        self.a = draw.integers(0, 1 << 63, positions, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, positions, np.uint64)

    def sign(self, grams: np.ndarray) -> np.ndarray:
        """The low 16 bits of the mixed minimum of each of the hash functions."""
        low = np.full(len(self.a), ~np.uint64(0))
        for i in range(0, len(grams), 2048):
            part = np.multiply.outer(self.a, grams[i : i + 2048])
            part += self.b[:, None]
            np.minimum(low, part.min(1), out=low)
        low ^= low >> np.uint64(32)
        low *= _STEP
        return (low >> np.uint64(48)).astype(np.uint16)


def signatures(df: DataFrame, id_col: str, text_col: str, n: int, positions: int) -> DataFrame:
    """id, n_shingles, skey (names the set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(positions)
        for batch in batches:
            size, key, sig = [], [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), n)
                size.append(len(grams))
                key.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                sig.append(signer.sign(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n_shingles", "skey", "sig"]
            )

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_shingles long, skey binary, sig binary")


def chunk_keys(positions: int, chunks: int, distance: int) -> list[list[int]]:
    """For each chunk and each set of positions allowed to be in error, the positions that must agree."""
    errors, at = distance // chunks, [round(i * positions / chunks) for i in range(chunks + 1)]
    return [[p for p in range(a, b) if p not in out] for a, b in zip(at, at[1:], strict=False) for out in combinations(range(a, b), errors)]


def key_rows(classes: DataFrame, positions: int, chunks: int, distance: int) -> DataFrame:
    """key, rep: one row for each class and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = chunk_keys(positions, chunks, distance)
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(rep), positions).astype(np.uint64)
            for i, cols in enumerate(wanted):
                key = np.full(len(rep), np.uint64(i + 1))
                for c in cols:
                    key = (key ^ (key >> np.uint64(29))) * _STEP + sig[:, c]
                key = (key ^ (key >> np.uint64(32))) * _MIX
                key = (key << np.uint64(SLOT_BITS)) | np.uint64(i)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rep)], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _sets(df: DataFrame, id_col: str, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    """rep, grams: the full sets of the wanted ids (distinct); few texts beside theirs are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingles(t.as_py(), n).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["rep", "grams"])

    docs = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).filter("rep is not null and text is not null")
    return likely(docs, F.col("rep"), wanted, F.col("rep")).join(wanted, "rep").select("rep", "text").mapInArrow(run, "rep long, grams array<long>").filter("size(grams) > 0")


def _close(pairs: DataFrame, classes: DataFrame, distance: int, percent: int) -> DataFrame:
    """The pairs a, b whose sizes allow the similarity and whose signatures differ in at most distance positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array((x != y).sum(1) <= distance)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    a = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    b = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(b, "b").join(a, "a").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""
    a, b = (sets.select(F.col("rep").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(b, "b").join(a, "a").filter(both * 100 >= (F.size("ga") + F.size("gb") - both) * percent).select("a", "b")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, exactly."""
    every, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    size = np.array([len(s) for s in [*x, *y]])
    row = np.repeat(np.arange(len(size)), size)
    shared = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, len(every), 4096):
        inside = (place >= start) & (place < start + 4096)
        dense = np.zeros((len(size), min(4096, len(every) - start)), np.float32)
        dense[row[inside], place[inside] - start] = 1
        shared += dense[: len(x)] @ dense[len(x) :].T
    return shared


def _complete(members: DataFrame, sets: DataFrame, index: list[list[int]], distance: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links between different components within keys; members: key, rep, comp, n_shingles, sig.

    Members are dealt to blocks. The largest component of a key needs no comparison
    with itself, so its blocks meet only the blocks of the rest. Signatures first
    show which members have a partner in the other block that is near enough and
    shares no earlier key; only their full sets are fetched and compared.
    """
    largest = members.groupBy("key", "comp").agg(F.count("*").alias("docs")).groupBy("key").agg(F.max(F.struct("docs", "comp"))["comp"].alias("main"))
    tagged = scratch.keep(members.join(largest, "key").withColumn("rest", F.col("comp") != F.col("main")).drop("main"), "tagged")
    size = lambda part: F.greatest(F.ceil(F.count(F.when(part, 1)) / BLOCK_DOCS), F.ceil(F.coalesce(F.sum(F.when(part, F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    blocks = tagged.groupBy("key").agg(size(F.col("rest")).alias("nr"), size(~F.col("rest")).alias("nm"))
    placed = tagged.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int"))
    # A block of the rest goes to all blocks of the main component, and with each other block of the rest to one place.
    rest, last = F.col("rest"), F.col("nr") + F.col("nm") - 1
    as_left = F.transform(F.sequence("block", last), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_right = F.transform(F.sequence(F.lit(0), F.when(rest, F.col("block")).otherwise(F.col("nr") - 1)), lambda i: F.struct(i.alias("i"), F.when(rest, F.col("block")).otherwise(F.col("block") + F.col("nr")).alias("j"), F.lit(1).alias("side")))
    sides = placed.select("key", "rep", "comp", "n_shingles", "sig", F.explode(F.when(rest, F.concat(as_left, as_right)).otherwise(as_right)).alias("at"))
    sides = sides.select("key", "rep", "comp", "n_shingles", "sig", "at.i", "at.j", "at.side")

    def near(table: pa.Table) -> pa.Table:
        side, comp, n = (table.column(c).to_numpy() for c in ("side", "comp", "n_shingles"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(side), -1)
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        active = np.zeros(len(side), bool)
        earlier = index[: int(table.column("key")[0].as_py()) & ((1 << SLOT_BITS) - 1)] if table.num_rows else []
        for start in range(0, len(l), 64):
            part = l[start : start + 64]
            same = sig[part][:, None, :] == sig[r][None, :, :]
            ok = (same.shape[2] - same.sum(2) <= distance) & (comp[part][:, None] != comp[r][None, :])
            ok &= np.minimum(n[part][:, None], n[r][None, :]) * 100 >= np.maximum(n[part][:, None], n[r][None, :]) * percent
            i, j = np.nonzero(ok)
            agree, new = same[i, j], np.ones(len(i), bool)
            for columns in earlier:
                new &= ~agree[:, columns].all(1)
            active[part[i[new]]] = True
            active[r[j[new]]] = True
        return table.filter(pa.array(active)).select(["key", "i", "j", "side", "rep", "comp"])

    def compare(table: pa.Table) -> pa.Table:
        side, comp, rep = (table.column(c).to_numpy() for c in ("side", "comp", "rep"))
        grams = [np.asarray(g.values) for g in table.column("grams").combine_chunks()]
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links: dict[tuple[int, int], tuple[int, int]] = {}  # one link for each pair of components is enough
        if len(l) and len(r):
            x, y = [grams[i] for i in l], [grams[i] for i in r]
            both = _overlaps(x, y)
            size = np.array([len(g) for g in x])[:, None] + np.array([len(g) for g in y])[None, :] - both
            for i, j in zip(*np.nonzero((both * 100 >= size * percent) & (comp[l][:, None] != comp[r][None, :])), strict=True):
                links.setdefault((comp[l[i]], comp[r[j]]), (rep[l[i]], rep[r[j]]))
        return pa.table({"a": pa.array([a for a, _ in links.values()], pa.int64()), "b": pa.array([b for _, b in links.values()], pa.int64())})

    active = sides.groupBy("key", "i", "j").applyInArrow(near, "key long, i int, j int, side int, rep long, comp long")
    return active.join(sets, "rep").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
    positions: int = POSITIONS,
    chunks: int = CHUNKS,
    distance: int = DISTANCE,
) -> DataFrame:
    """Per row of df: id, n_shingles, component_id (smallest id reachable), kept (id = component_id)."""
    scratch = Scratch(session_of(df), "near")
    signed = scratch.keep(signatures(df, id_col, text_col, n, positions), "signed")
    known = signed.filter("skey is not null and id is not null")
    classes = scratch.keep(known.groupBy("skey").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    keys = key_rows(classes, positions, chunks, distance)
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("key", "hub")
    members = scratch.keep(keys.join(hubs, "key"), "members")

    pairs = _close(members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), classes, distance, percent)
    wanted = scratch.keep(members.select("rep").distinct(), "wanted")
    sets = scratch.keep(_sets(df, id_col, text_col, n, wanted), "sets")
    twice = _same_id_links(signed)
    links = scratch.keep(_linked(pairs, sets, percent).union(twice), "links")
    labels = components(links, scratch)

    # Keys whose members are not yet in one component; of two members, one is the hub, and they have been compared.
    comp = F.coalesce("label", "rep").alias("comp")
    placed = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", comp)
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low < high and n > 2").select("key")
    still = placed.join(mixed, "key", "left_semi").join(classes.select("rep", "n_shingles", "sig"), "rep")
    more = scratch.keep(_complete(still, sets, chunk_keys(positions, chunks, distance), distance, percent, scratch), "more")
    scratch.drop(members)
    final = components(links.union(more), scratch)
    scratch.drop(sets)

    named = signed.select("id", "n_shingles", "skey").join(classes.select("skey", "rep"), "skey", "left")
    named = named.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("label", "rep", "id")
    return named.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.coalesce(component == F.col("id"), F.lit(True))).alias("kept"))


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """df with one document of each group of near duplicates, the one with the smallest id.

    All rows of an id stay or go together, and stay if one of them does. Rows whose id
    is surely not among those that go are not shuffled.
    """
    scratch = Scratch(session_of(df), "near")
    [name] = fresh(df, "id")
    judged = near_duplicates(df, id_col=id_col, text_col=text_col, n=n, percent=percent)
    gone = scratch.keep(judged.groupBy(F.col(id_col).alias(name)).agg(F.bool_or("kept").alias("kept")).filter("not kept").select(name), "gone")
    key = F.col(f"`{id_col}`").cast("long")
    checked = likely(df, key, gone, F.col(name)).join(gone, key == F.col(name), "left").filter(F.col(name).isNull()).drop(name)
    return checked.unionByName(unlikely(df, key, gone, F.col(name)))


def _same_id_links(signed: DataFrame) -> DataFrame:
    """Links from rows of one id with different sets: their classes' smallest ids belong together."""
    known = signed.filter("skey is not null and id is not null").select("id", "skey")
    ids = known.groupBy("id").agg(F.min("skey").alias("low"), F.max("skey").alias("high")).filter("low <> high").select("id")
    held = known.join(ids, "id", "left_semi")
    reps = known.join(held.select("skey").distinct(), "skey", "left_semi").groupBy("skey").agg(F.min("id").alias("rep"))
    return held.join(reps, "skey").select(F.col("id").alias("a"), F.col("rep").alias("b"))
