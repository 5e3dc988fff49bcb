"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash draws, for each element of a set, a random order of the slots and rising values level
by level, so the slots of a signature are correlated and vary less than those of plain MinHash; a
document is done as soon as every slot holds a value below the next level. BANDS bands of ROWS slots
miss a pair of similarity 0.8 about three times in a million.

Documents of equal sets are one class from the start. The classes that share a band with others are
compared exactly:

* first, in each band's bucket, every class with one pivot, the class that shares most bands;
* then, in buckets that still hold several components, all pairs of different components where the
  bucket is small, else every class with eight more pivots;
* last, in large buckets that still aren't one component, all classes outside of the bucket's
  largest component against all its classes of like set sizes (others can't be alike), chunks of about CHUNK of
  the ones against chunks of the others, each pair in one bucket only.

So no link between different components that share a bucket is lost, no bucket's pairs are
emitted, and no task gathers more of a bucket than two chunks, or the bucket if it has SMALL rows at most. What all rows of a
frequent key must learn (its size, its pivot) is broadcast for the keys with more than a twenty-thousandth of the
rows, which are 20,000 at most, and joined by a shuffle for the others. Links are grouped by union-find inside the
partitions, then by the large-star and small-star rounds between them.

Rows: a null text has no words; a text without words has an empty set and is linked with nothing; a
text of fewer words than a shingle has the whole sequence as its one element. Rows of one doc_id are
one document: what its texts are linked with is one component. A very long text is hashed at once (some 60 bytes a word)
and signed in runs of RUN shingles. Rows with a null doc_id take no part: their component is null and they are kept.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.llm.common import Windows, as_bytes, mix, parts_for, slices, starts_of, stored, told

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
SMALL, CHUNK, RUN = 48, 512, 1 << 18
#: More ids than this aren't broadcast; the join is shuffled then.
MOST_IDS = 2_000_000


def shingle_sets(texts: list[bytes], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text's shingles, one text after the other; how many each has)."""
    words = [t.lower().split() for t in texts]
    h, _, doc, _ = windows(words)
    short = [k for k, w in enumerate(words) if 0 < len(w) < windows.n]
    if short:
        whole = np.frombuffer(b"".join(blake2b(b"short " + b" ".join(words[k]), digest_size=8).digest() for k in short), np.uint64)
        h, doc = np.concatenate((h, whole)), np.concatenate((doc, np.array(short, np.int64)))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[first], doc[first]
    return h, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def superminhash(h: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents, slots): level in the high byte, 24 random bits below."""
    top = np.uint32(0xFFFFFFFF)
    if len(h) > RUN:  # the least of runs is that of all
        doc, sig = np.repeat(np.arange(len(sizes)), sizes), np.full((len(sizes), slots), top, np.uint32)
        for at in range(0, len(h), RUN):
            sig = np.minimum(sig, superminhash(h[at : at + RUN], np.bincount(doc[at : at + RUN], minlength=len(sizes)), slots))
        return sig
    sig = np.full(len(sizes) * slots, top, np.uint32)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
    for level in range(slots):
        if not len(h):
            break
        drawn = mix(h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at, row = level + (drawn % np.uint64(slots - level)).astype(np.int64), np.arange(len(h))
        slot = order[row, at]
        order[row, at] = order[:, level]
        value = (np.uint32(level) << np.uint32(24)) | (drawn >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(sig, doc * slots + slot, value)
        open_ = sig.reshape(-1, slots).max(axis=1) >= np.uint32(min(level + 1, 255) << 24)
        stay = open_[doc]
        if not stay.all():
            h, doc, order = h[stay], doc[stay], order[stay]
    return sig.reshape(-1, slots)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS))
    for k in range(ROWS):
        key = mix(key ^ parts[:, :, k])
    return key.view(np.int64) if key.flags.c_contiguous else np.ascontiguousarray(key).view(np.int64)


FEATURES = "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"


def _features(n: int):
    def run(batches):
        windows = Windows(n)
        for batch in slices(batches, most=1 << 20):
            h, sizes = shingle_sets(as_bytes(batch), windows)
            keys = band_keys(superminhash(h, sizes))
            full = sizes > 0
            sums = np.zeros((2, len(sizes)), np.uint64)
            for k, salt in enumerate((1, 0xD6E8FEB86659FD93)):
                if full.any():
                    sums[k, full] = np.add.reduceat(mix(h ^ np.uint64(salt)), starts_of(sizes)[full])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], names=["doc_id", "n", "s1", "s2", "bands"])

    return run


def _sets(n: int):
    """(id, its set as sorted 64-bit hashes)"""

    def run(batches):
        windows = Windows(n)
        for batch in slices(batches, most=1 << 20):
            h, sizes = shingle_sets(as_bytes(batch), windows)
            at = starts_of(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([h[a : a + s].tobytes() for a, s in zip(at, sizes, strict=True)], pa.binary())], names=["id", "elements"])

    return run


def _verify(per_cent: int):
    """Links among the (pivot, member) pairs of a bucket of pairs, by the sizes of the full sets."""

    def run(pivots: pa.Table, members: pa.Table) -> pa.Table:
        held = {}
        for p, blob in zip(pivots.column("pivot").to_pylist(), pivots.column("elements").to_pylist(), strict=True):
            held.setdefault(p, []).append(np.frombuffer(blob, np.uint64))
        a, b = [], []
        for p, m, blob in zip(members.column("pivot").to_pylist(), members.column("member").to_pylist(), members.column("elements").to_pylist(), strict=True):
            y = np.frombuffer(blob, np.uint64)
            for x in held.get(p, ()):
                if len(x) and len(y):
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    common = int((x[at] == y).sum())
                    if 100 * common >= per_cent * (len(x) + len(y) - common):
                        a.append(min(p, m))
                        b.append(max(p, m))
                        break
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int, groups: int) -> DataFrame:
    """The pairs (pivot, member) whose sets are alike, as links a < b. A hot pivot's members are dealt to chunks."""
    chunks = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    chunks = stored(chunks.withColumn("chunks", F.ceil(F.col("size") / 128).cast("int")), "near-chunks")
    group = lambda chunk: F.pmod(F.xxhash64("pivot", chunk), F.lit(groups))
    left = chunks.join(sets, F.col("pivot") == F.col("id")).select("pivot", "elements", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    left = left.select(F.col("pivot").alias("pivot"), F.col("elements").alias("elements"), group(F.col("chunk")).alias("g"))  # new columns, else both sides share them
    right = told(pairs, chunks, ["pivot"]).join(sets, F.col("member") == F.col("id"))
    right = right.select("pivot", "member", "elements", group(F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int")).alias("g"))
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_verify(per_cent), "a bigint, b bigint").distinct()


def _union_find(batches):
    """(node, smallest node of its component in this part) for the links of a part."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out():
        nodes = list(parent)
        rows = [(find(x), x) for x in nodes]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.record_batch({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:  # a part of any size: what is known so far goes out, and the rest starts anew
            yield out()
            parent.clear()
    if parent:
        yield out()


def connected(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id in ``links`` (a < b) reaches; ids that are smallest themselves have no row."""
    edges = stored(links.mapInArrow(_union_find, "a bigint, b bigint").distinct(), "near-edges")
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = stored(large, "near-large-star")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = stored(small, "near-small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
        seen = now


def _few(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` (ids only) where it is stored and proven small, else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(MOST_IDS + 1).count() <= MOST_IDS else df


def _blocks(per_cent: int):
    """Links between the outliers of a bucket and a chunk of its members; one for each outlier and component that it meets.

    A pair that shares an earlier band is left to that band's bucket, so each pair is compared once.
    """

    def run(outliers: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        if outliers.num_rows and members.num_rows:
            sets = [np.frombuffer(x, np.uint64) for x in members.column("elements").to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            every, first = np.concatenate(sets), starts_of(sizes)
            bands = np.array(members.column("bands").to_pylist(), np.int64)
            ids, component = members.column("rep").to_numpy(), members.column("component").to_numpy()
            at = int(np.flatnonzero(bands[0] == members.column("key")[0].as_py())[0])
            for o, c, own, x in zip(*(outliers.column(k).to_pylist() for k in ("rep", "component", "bands", "elements")), strict=True):
                x = np.frombuffer(x, np.uint64)
                hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
                common = np.add.reduceat(hit, first, dtype=np.int64)
                alike = (100 * common >= per_cent * (len(x) + sizes - common)) & (component != c)
                alike &= ~(bands[:, :at] == np.array(own[:at], np.int64)).any(axis=1)
                found = np.flatnonzero(alike)
                for k in found[np.unique(component[found], return_index=True)[1]]:
                    a.append(min(o, int(ids[k])))
                    b.append(max(o, int(ids[k])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compared_in_blocks(open_: DataFrame, sets: DataFrame, reps: DataFrame, per_cent: int) -> DataFrame:
    """Links of each bucket's rows outside of its largest component with all its rows of like sizes, chunks against chunks."""
    most = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n_")).groupBy("key").agg(F.max(F.struct("n_", "component")).alias("m_"), F.sum("n_").alias("size"))
    most = stored(most.select("key", F.col("m_.component").alias("main"), "size"), "near-main")
    # sizes of like sets are in the same class or in neighbouring ones
    like = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / per_cent * 1.0001)))).cast("int")
    rows = told(open_.drop("size"), most, ["key"]).select("key", "rep", "component", (F.col("component") != F.col("main")).alias("outlier"), like.alias("like"))
    rows = stored(rows, "near-blocks")
    there = F.explode(F.array(F.col("like") - 1, F.col("like"), F.col("like") + 1)).alias("like")
    outliers = rows.where("outlier").select("key", "rep", "component", there)
    count = lambda df, name: df.groupBy("key", "like").agg(F.count(F.lit(1)).alias(name))
    groups = count(rows, "members").join(count(outliers, "others"), ["key", "like"])
    chunked = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    groups = stored(groups.select("key", "like", (F.col("members") + F.col("others")).alias("size"), chunked("members").alias("mine"), chunked("others").alias("theirs")), "near-groups")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    fetched = lambda df: df.join(sets, F.col("rep") == F.col("id")).join(reps.select("rep", "bands"), "rep")
    columns = ["key", "like", "rep", "component", "bands", "elements", "o", "m"]
    left = fetched(told(outliers, groups, ["key", "like"]).withColumn("o", own("theirs")).withColumn("m", all_of("mine"))).select(*[F.col(c).alias(c) for c in columns])
    right = fetched(told(rows.drop("outlier"), groups, ["key", "like"]).withColumn("m", own("mine")).withColumn("o", all_of("theirs"))).select(*[F.col(c).alias(c) for c in columns])
    at = ["key", "like", "o", "m"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_blocks(per_cent), "a bigint, b bigint").distinct()


def _links(docs: DataFrame, reps: DataFrame, n: int, per_cent: int) -> DataFrame | None:
    """(id, component) over the classes in ``reps`` (rep, n, bands)."""
    alike = lambda x, y: 100 * F.least(x, y) >= per_cent * F.greatest(x, y)  # noqa: E731  else the sets can't be
    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    shared = stored(told(rows, sizes, ["key"]), "near-buckets")
    central = stored(shared.groupBy("rep").agg(F.sum("size").alias("score")), "near-central")
    count, total = central.join(reps, "rep").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not count:
        return None
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    wanted = texts.join(_few(central.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    sets = stored(wanted.mapInArrow(_sets(n), "id bigint, elements binary"), "near-sets")
    groups = parts_for(total * 8 * 4, 4 << 20)
    item = F.struct("rep", "n", "component")

    def starred(open_: DataFrame, salts: int, turn: int) -> DataFrame:
        """Each row of a bucket with its central row, or with the central rows of ``salts`` parts, of another component."""
        best = F.max(F.struct("score", (-F.col("rep")).alias("least"), "n", "component")).alias("best")
        pivots = open_.groupBy("key", F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(salts)).alias("salt")).agg(best, F.max("size").alias("size"))
        pivots = stored(pivots.select("key", "size", (-F.col("best.least")).alias("pivot"), F.col("best.n").alias("pn"), F.col("best.component").alias("pc")), "near-pivots")
        return told(open_.drop("size"), pivots, ["key"]).where((F.col("component") != F.col("pc")) & alike(F.col("n"), F.col("pn"))).select("pivot", F.col("rep").alias("member"))

    def still_open(open_: DataFrame, components: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components, with their components of now."""
        left = open_.drop("component").join(components.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        left = stored(left, "near-now")
        several = left.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("size").alias("size")).where("c1 <> c2").select("key", "size")
        return stored(told(left.drop("size"), stored(several, "near-several"), ["key"]).select("key", "rep", "n", "size", "score", "component"), "near-open")

    open_ = shared.join(central, "rep").select("key", "rep", "n", "size", "score", F.col("rep").alias("component"))
    first = stored(starred(open_, 1, 0).distinct(), "near-pairs")
    links = stored(verified(first, sets, per_cent, groups), "near-links")
    components = connected(links)
    open_ = still_open(open_, components)
    if open_.isEmpty():
        return components
    few = open_.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("all"))
    few = few.select("all", F.explode("all").alias("x")).select("x", F.explode(F.filter("all", lambda y: (y["rep"] > F.col("x.rep")) & (y["component"] != F.col("x.component")))).alias("y"))
    few = few.where(alike(F.col("x.n"), F.col("y.n"))).select(F.col("x.rep").alias("pivot"), F.col("y.rep").alias("member"))
    large = open_.where(F.col("size") > SMALL)
    pairs = few.unionByName(starred(large, 8, 1)).distinct()
    for tried in (first, first.select(F.col("pivot").alias("member"), F.col("member").alias("pivot"))):
        pairs = pairs.join(tried, ["pivot", "member"], "left_anti")
    links = links.unionByName(stored(verified(stored(pairs, "near-pairs"), sets, per_cent, groups), "near-links"))
    components = connected(links)
    open_ = still_open(large, components)
    if open_.isEmpty():
        return components
    return connected(links.unionByName(stored(_compared_in_blocks(open_, sets, reps, per_cent), "near-links")))


def _united(rows: DataFrame, reps: DataFrame, found: DataFrame | None) -> DataFrame | None:
    """(id, component) where the classes of one doc_id's texts are one component too."""
    same = ["n", "s1", "s2"]
    ends = rows.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("a"), F.max(F.struct(*same)).alias("b")).where("a <> b").select("doc_id")
    several = stored(ends, "near-several-texts")
    if several.isEmpty():
        return found
    mine = stored(told(rows.join(several, "doc_id").distinct(), reps, same).select("doc_id", "rep"), "near-own-classes")
    least = mine.groupBy("doc_id").agg(F.min("rep").alias("a"))
    links = mine.join(least, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    if found is not None:
        links = links.unionByName(found.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")))
    return connected(links)


def components(docs: DataFrame, n: int = 2, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(docs.mapInArrow(_features(n), FEATURES), "near-features")
    same = ["n", "s1", "s2"]
    taking = rows.where("n > 0 and doc_id is not null")
    reps = stored(taking.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("size")), "near-classes")
    found = _links(docs, reps.select("rep", "n", "bands"), n, per_cent)
    found = _united(taking.select("doc_id", *same), reps.select(*same, "rep", "size"), found)
    classes = reps.select(*same, "rep", "size")
    if found is not None:
        classes = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        classes = classes.select(*same, "size", F.coalesce("component", "rep").alias("component"))
    else:
        classes = classes.select(*same, "size", F.col("rep").alias("component"))
    rows = rows.drop("bands")
    rest = rows.where("n = 0 or doc_id is null").withColumn("component", F.lit(None).cast("long"))
    out = told(rows.where("n > 0 and doc_id is not null"), stored(classes, "near-components"), same).select(*rest.columns).unionByName(rest)
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their component, with their own columns."""
    gone = stored(components(docs, n, per_cent).where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.join(_few(gone), "doc_id", "left_anti").select(*docs.columns)
