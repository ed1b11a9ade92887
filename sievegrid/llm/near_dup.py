"""Near-duplicate groups: SetSketch registers, banding, joint likelihood, then exact verification on full sets.

1. Each text's set of word shingles gives a digest and 128 registers. Texts of equal sets form one class, found by
   grouping on the digest, so copies never meet pairwise.
2. Registers in 32 bands of 4 are grouped by value. Within a bucket every class is paired with one hub only, so a
   bucket of g classes makes g - 1 pairs. The hub is the class whose buckets are largest in all: of texts copied with
   changes, the one that they were copied from.
3. Pairs whose joint likelihood rules the threshold out are dropped, the rest verified on full sets, salted by hub.
   All texts are shuffled once, to keep those that share a band with another; joins with texts merge at every size.
4. In buckets that still hold several components, classes outside the largest are fitted to and verified against all
   others, in blocks of bounded size; only links come out. So every pair that shares a band is linked, found to be apart,
   or already in one component: no cap on partners.

At similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^32, about 5e-8.

Defined cases: a text without words (or null) has an empty set and links with nothing; a text of fewer words than the
shingle has one shingle, all its words; rows that repeat an id are one document that has all their texts; rows
without an id are not linked, have a null component and are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm import setsketch
from sievegrid.llm.textvec import U, mix, shingle_sets
from sievegrid.operators.graph import connected_components
from sievegrid.session import stage, unstage

BAND_ROWS = 4
#: Total size of the sets in a block of a bucket.
BLOCK_SHINGLES = 400_000
MEMBERS_PER_SALT = 64
#: A pair is dropped unseen if its best fit is below the threshold and so much likelier (in log) than the threshold.
RULED_OUT = 22.0


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, d1, d2, regs) of every row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, values, bounds in shingle_sets(batch.column(1), width):
                sums = [np.concatenate([[U(0)], np.cumsum(v)]) for v in (values, mix(values ^ U(0xA0761D6478BD642F)))]
                d1, d2 = [(s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64) for s in sums]
                regs = setsketch.registers(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(bounds)), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["id", "n", "d1", "d2", "regs"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, regs binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = setsketch.bands(_registers(batch.column(1)), BAND_ROWS)
            owner = np.repeat(np.arange(batch.num_rows), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(owner))], names=["key", "rep"])

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "regs").mapInArrow(run, f"key long, rep {kind}")


def _possible(n_a: np.ndarray, n_b: np.ndarray, regs_a: np.ndarray, regs_b: np.ndarray, threshold: float) -> np.ndarray:
    best, above = setsketch.joint_fit(regs_a, regs_b, n_a, n_b, threshold)
    return (best >= threshold) | (above < RULED_OUT)


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the joint likelihood doesn't rule out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            keep = _possible(n_a, n_b, _registers(batch.column(4)), _registers(batch.column(5)), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. A hub's pairs are salted."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS_PER_SALT)).alias("salts"))
    members = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    hubs = degree.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"))
    rows = members.unionByName(hubs).join(docs.select("id", "text").hint("merge"), "id").select("a", "salt", "role", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub_sets = None, []
        for batch in batches:
            a, salt, role, ident = (batch.column(i).to_pylist() for i in range(4))
            out_a, out_b = [], []
            for first, last, values, bounds in shingle_sets(batch.column(4), width):
                for i in range(first, last):
                    own = values[bounds[i - first] : bounds[i - first + 1]]
                    if (a[i], salt[i]) != group:
                        group, hub_sets = (a[i], salt[i]), []
                    if role[i] == 0:
                        hub_sets.append(own.copy())
                        continue
                    for hub in hub_sets:
                        small, large = (own, hub) if len(own) < len(hub) else (hub, own)
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        shared = int((large[at] == small).sum()) if len(large) else 0
                        if shared and 100 * shared >= percent * (len(own) + len(hub) - shared):
                            out_a.append(a[i])
                            out_b.append(ident[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, batch.column(0).type), pa.array(out_b, batch.column(0).type)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, f"a {kind}, b {kind}")


@cache
def _least_alike(threshold: float, ratios: int = 21) -> int:
    """The fewest equal registers that the likelihood does not rule out, of sets of any sizes that the threshold allows.

    Tried are all numbers of greater and less registers, at ``ratios`` ratios of the sizes from the threshold to 1.
    """
    m = setsketch.REGISTERS
    size = 100_000
    for same in range(m + 1):
        more, ratio = (x.ravel() for x in np.meshgrid(np.arange(m - same + 1), np.linspace(threshold, 1, ratios)))
        best, above = setsketch.fit_counts(more, m - same - more, np.full(len(more), same), np.full(len(more), size), np.ceil(size * ratio), threshold)
        if ((best >= threshold) | (above < RULED_OUT)).any():
            return max(same, 1)
    return m


def _common(sets: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """How much of each set other sets hold; sets of one name are the same set. No two share more than the lesser of theirs."""
    first = np.unique(names, return_index=True)[1]
    values, held = np.unique(np.concatenate([sets[i] for i in first]), return_counts=True)
    return np.array([(held[np.searchsorted(values, s)] > 1).sum() for s in sets])


def _shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others, none of them empty."""
    every = np.concatenate(many)
    found = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    return np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in many])[:-1]]))


def _open_links(members: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) of pairs that share a bucket, are in different components and were not paired with its hub.

    At least one of such a pair is outside its bucket's largest component. Those are dealt to blocks against all
    of the bucket, by total set size, so a task's group is bounded whatever the bucket holds. Inside a group pairs go whose sizes, or
    whose shingles that any other text of the group has, are too few to link them; of the rest the most alike come
    first and a component once reached is not tried again; a pair is tested where it shares its first band only.
    """
    threshold = percent / 100
    named = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = by.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("main")).where("parts > 1 and size > 2")
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"))
    rows = named.join(mixed.select("key", "main"), "key").join(sizes, "rep").withColumn("open", F.col("component") != F.col("main"))
    rows = stage(rows.select("key", "rep", "component", "open", "n", (F.col("rep") == F.col("hub")).alias("is_hub")), "open-members")
    blocks = rows.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).alias("all"), F.ceil(F.sum(F.when(F.col("open"), F.col("n"))) / F.lit(BLOCK_SHINGLES)).alias("opens"))
    rows = rows.join(blocks, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    sides = rows.select("key", place("all").alias("i"), every("opens").alias("j"), F.lit(0).alias("role"), "rep", "component", "open", "is_hub")
    sides = sides.unionByName(rows.where("open").select("key", every("all").alias("i"), place("opens").alias("j"), F.lit(1).alias("role"), "rep", "component", "open", "is_hub"))
    texts = sides.join(docs.select(F.col("id").alias("rep"), "text").hint("merge"), "rep").select("key", "i", "j", "role", "rep", "component", "open", "is_hub", "text")

    least = _least_alike(threshold)

    def links_of(held: list[tuple]) -> tuple[list, list]:
        _, role, rep, component, is_open, is_hub, own, regs = zip(*held, strict=True)
        role, is_open, is_hub = np.array(role), np.array(is_open), np.array(is_hub)
        sets, regs = list(own), np.stack(regs)
        n, keys = np.array([len(x) for x in sets]), setsketch.bands(regs, BAND_ROWS)
        band = int(np.flatnonzero(keys[0] == held[0][0][0])[0]) if (keys[0] == held[0][0][0]).any() else 0
        label = np.unique([str(c) for c in component], return_inverse=True)[1]
        root = np.arange(label.max() + 1)
        order = np.argsort(np.argsort(np.array(rep)))
        common = _common(sets, np.array(rep))
        others = np.flatnonzero(role == 0)
        o_n, o_common, o_label, o_order = n[others], common[others], label[others], order[others]
        o_hub, o_closed = is_hub[others], ~is_open[others]
        out_a, out_b = [], []
        for x in np.flatnonzero(role == 1):
            if is_hub[x]:
                continue
            most = np.minimum(o_common, common[x])
            fine = (100 * most >= percent * (o_n + n[x] - most)) & (root[o_label] != root[label[x]]) & ~o_hub & (o_closed | (o_order > order[x]))
            rest = others[fine]
            if not len(rest):
                continue
            alike = (regs[rest] == regs[x]).sum(1)
            fine = (alike >= least) & ~(keys[rest, :band] == keys[x, :band]).any(1)
            rest, alike = rest[fine], alike[fine]
            rest = rest[np.argsort(-alike, kind="stable")]
            step = 8  # the most alike come first; what they link needs no test
            while len(rest):
                some, rest = rest[:step], rest[step:]
                shared = _shared(sets[x], [sets[y] for y in some])
                for y in some[100 * shared >= percent * (n[x] + n[some] - shared)]:
                    if root[label[y]] != root[label[x]]:
                        out_a.append(rep[x])
                        out_b.append(rep[y])
                        root[root == root[label[y]]] = root[label[x]]
                rest, step = rest[root[label[rest]] != root[label[x]]], 512
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = None

        def done() -> pa.RecordBatch:
            a, b = links_of(held)
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

        for batch in batches:
            kind = batch.column(4).type
            plain = [batch.column(i).to_pylist() for i in range(8)]
            for first, last, values, bounds in shingle_sets(batch.column(8), width):
                regs = setsketch.registers(values, bounds)
                for r in range(first, last):
                    group = tuple(c[r] for c in plain[:3])
                    if held and held[0][0] != group:
                        yield done()
                        held.clear()
                    own = values[bounds[r - first] : bounds[r - first + 1]].copy()
                    held.append((group, *[c[r] for c in plain[3:]], own, regs[r - first].copy()))
        if held:
            yield done()

    kind = members.schema["rep"].dataType.simpleString()
    return texts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    component_id is the smallest id that links reach; kept is true for that one. Texts are linked if their sets of
    ``width``-word shingles (A-Z lower-cased) have 100 * intersection >= percent * union.
    """
    threshold = percent / 100
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    known = base.where("id is not null")
    sketched = stage(sketches(base, width), "sketches")
    able = sketched.where("id is not null and n > 0")
    classes = stage(able.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.any_value("regs").alias("regs")), "classes")
    copies = able.select("id", "n", "d1", "d2").join(classes.select("rep", "n", "d1", "d2"), ["n", "d1", "d2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    found = _bands(classes)
    sizes = found.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(found.join(sizes, "key"), "band-sizes")
    central = stage(shared.groupBy("rep").agg(F.sum("size").alias("score")), "centrality")
    scored = shared.join(central, "rep").select("key", "rep", "score")
    hubs = scored.groupBy("key").agg(F.min_by("rep", F.struct(-F.col("score"), "rep")).alias("hub"))
    members = stage(scored.join(hubs, "key"), "band-members")
    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    likely = stage(_likely(stars, classes, threshold), "likely")
    shared_texts = stage(known.join(central.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi"), "shared-texts")
    links = stage(_verified(likely, shared_texts, width, percent), "links")
    labels = stage(connected_components(copies.unionByName(links), "a", "b"), "labels")

    more = stage(_open_links(members, classes, labels, shared_texts, width, percent), "open-links")
    if not more.isEmpty():
        labels = stage(connected_components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), "a", "b"), "labels")
    out = sketched.select("id", "n").join(labels, F.col("id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = stage(out, "near-duplicates")
    for done in (sketched, classes, members, shared, central, likely, shared_texts, links, more):
        unstage(done)
    return out
