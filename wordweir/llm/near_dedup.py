"""MinHash near-dedup by DartMinHash (weighted Jaccard on word shingles).

A text is the multiset of its shingles of five words (a text of one to four words is one shingle). Each
copy of a shingle is a region of weight one. Darts fall on a region as a Poisson process over ranks: the
next dart's rank is the previous one's plus an exponential number, drawn from the hash of region and dart
number, and each dart is thrown at one of ``COORDINATES`` coordinates. Only ranks up to a bound are
generated; the bound is inversely proportional to the text's weight, so a text costs O(weight + k log k),
and it is doubled for a text with a coordinate that no dart hit. The earliest dart of each coordinate is the signature:
two texts agree in a coordinate with a probability of exactly their weighted Jaccard similarity.

Plan: texts with equal words become one node first (pre-aggregated, so that copies cost nothing further).
Nodes that share a band of the signature share a bucket, and the buckets of one lead (the node of the least hash) are one group. Each node
is compared with its lead (a star, not all pairs), exactly, on the shingle multisets; the links are contracted to classes.

In a group that still holds several classes, the nodes outside its largest class are compared with all nodes of other classes, in
blocks of bounded size. Where those are more than ``DIRECT`` pairs, ``LEADS`` more leads are tried first, which contracts dense
groups; then an exact prefix filter cuts sparse ones (texts of one template, say) apart: two sets that are 0.8 alike share one of
their first fifth and one regions in any fixed order. The order puts the lead's regions last, so what all of the group have in
common finds no one; each (lead, region) is a bucket of its own, and a group is compared by these buckets if they have fewer pairs
than the group. So no link between bucket partners is lost.

A hot group is no hot task: its rows are joined to copies of the lead's regions, one for every ``A_LEAD`` rows.

Defined cases: a null text is an empty one; texts without words are in one class if they are equal; classes are named by their smallest
document id (null ids: by the smallest other one, else null); repeated rows are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, cut, forget, hot_join, mix, released, row_words, to_batch

SHINGLE = 5
#: At a similarity of 0.8 two texts share at least one of 20 bands of 5 coordinates with probability 0.9996.
BANDS, ROWS = 20, 5
COORDINATES = BANDS * ROWS
#: Similarity of a link, as a fraction.
LINK = (8, 10)
#: Nodes on either side of a block in the second comparison.
MINOR_BLOCK, ALL_BLOCK = 192, 192
#: Rows of a group for each copy of its lead's regions; pairs of a group that are compared at once; further leads of larger groups.
A_LEAD, DIRECT, LEADS = 256, 1 << 22, 6
#: Links of a task; so few are contracted by one task in one step.
LINKS_A_TASK = 100_000

#: Columns of numbers, as a list could not be aggregated by hashing.
BAND_COLUMNS = [f"band{k:02d}" for k in range(BANDS)]

_STEP = U(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Regions of weight one, sorted within each text, and each text's number of them.

    A region is the hash of a shingle and of how many equal ones the text had before.
    """
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not n.sum():
        return np.zeros(0, U), n
    first = np.cumsum(counts) - counts
    begin = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    at = first[row] + np.arange(len(row)) - begin[row]
    take = np.minimum(counts, size)[row]
    value = take.astype(U)
    for k in range(size):
        there = k < take
        value = mix(value * _STEP + np.where(there, words[np.where(there, at + k, 0)], U(0)) * U(2 * k + 3))
    for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    runs = np.flatnonzero(new)
    copy = np.arange(len(value)) - np.repeat(runs, np.diff(np.append(runs, len(value))))
    regions = mix(value + copy.astype(U) * _STEP)
    return regions, n


def signatures(regions: np.ndarray, n: np.ndarray, k: int = COORDINATES, weights: np.ndarray | None = None) -> np.ndarray:
    """One row of ``k`` dart hashes for each text with regions; rows of texts without are zero.

    ``weights``: the part of each region, from 0 to 1, that the text covers (default: all of it); a dart counts
    if its place in the region lies below that.
    """
    out = np.zeros((len(n), k), U)
    reach = k * (np.log(k) + 1)
    todo = np.flatnonzero(n)
    begin = np.cumsum(n) - n
    while len(todo):
        sizes = n[todo]
        row = np.repeat(np.arange(len(todo)), sizes)
        at = np.repeat(begin[todo], sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        unit = regions[at]
        part = None if weights is None else weights[at]
        limit = reach / sizes
        rank = np.zeros(len(unit))
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        dart = 0
        while len(unit):
            dart += 1
            h = mix(unit + U(dart * 0xD1342543DE82EF95 % 2**64))
            rank = rank - np.log(((h >> U(11)) + U(1)).astype(np.float64) * 2.0**-53)
            near = rank <= limit[row]
            unit, row, rank, h = unit[near], row[near], rank[near], h[near]
            if part is not None:
                part = part[near]
                hit = (mix(h ^ U(0x632BE59BD9B4E019)) >> U(11)).astype(np.float64) * 2.0**-53 < part
                darts.append((row[hit] * k + (mix(h + _STEP) % U(k)).astype(np.int64)[hit], rank[hit], h[hit]))
            else:
                darts.append((row * k + (mix(h + _STEP) % U(k)).astype(np.int64), rank, h))
        cell, ranks, ids = (np.concatenate(x) for x in zip(*darts, strict=True))
        order = np.lexsort((ids, ranks, cell))
        cell, ids = cell[order], ids[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        got = np.zeros(len(todo) * k, U)
        got[cell[first]] = ids[first]
        full = np.bincount(cell[first] // k, minlength=len(todo)) == k
        out[todo[full]] = got.reshape(-1, k)[full]
        todo = todo[~full]
        reach *= 2
    return out


def bands(signature: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(signature), count), U)
    for r in range(rows):
        out = mix(out * _STEP + signature[:, r::rows][:, :count])
    return out


def word_keys(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128 bits of each text's word sequence."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(first, counts)
    full = counts > 0
    halves = []
    for step, salt in ((0xC2B2AE3D27D4EB4F, 0), (0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        key = np.zeros(len(counts), U)
        if len(words):
            # each word is mixed with its place before the sum
            key[full] = np.add.reduceat(mix(mix(words + U(salt)) + place.astype(U) * U(step)), first[full])
        halves.append(mix(key + counts.astype(U)))
    both = np.stack(halves, 1).astype(">u8")
    return [x.tobytes() for x in both]


def node_keys(texts: pa.Array, words: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Node of each text: its word sequence, or, if it has no words, the text itself (null is empty)."""
    keys = word_keys(words, counts)
    for i in np.flatnonzero(counts == 0).tolist():
        keys[i] = hashlib.blake2b((texts[i].as_py() or "").encode("utf-8", "replace"), digest_size=16).digest()
    return pa.array(keys, pa.binary())


def _sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids = part.column("id")
        more = [c for c in part.schema.names if c not in ("id", "text")]
        for row, end, words, counts in row_words(part.column("text")):
            regions, n = shingles(words, counts)
            found = bands(signatures(regions, n)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, end - row), node_keys(part.column("text").slice(row, end - row), words, counts), pa.array(n, pa.int64()),
                    *(pa.array(found[:, k]) for k in range(BANDS)), *(part.column(c).slice(row, end - row) for c in more),
                ],
                names=["id", "node", "n", *BAND_COLUMNS, *more],
            )


def _regions(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for row, end, words, counts in row_words(part.column("text")):
            regions, n = shingles(words, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    node_keys(part.column("text").slice(row, end - row), words, counts),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(regions.view(np.int64))),
                ],
                names=["node", "regions"],
            )


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number of each number's component; links a - b of the numbers below n."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        for side in (low[a], low[b], a, b):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _contract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), at most LINKS_A_TASK, to (node, root)."""
    links = [(p.column(0).to_pylist(), p.column(1).to_pylist()) for p in parts]
    a, b = ([x for one in links for x in one[k]] for k in (0, 1))
    names = sorted({*a, *b})
    number = {x: k for k, x in enumerate(names)}
    low = components(np.array([number[x] for x in a], np.int64), np.array([number[x] for x in b], np.int64), len(names))
    if names:
        yield to_batch(list(zip(names, (names[k] for k in low.tolist()), strict=True)), pa.schema([("node", pa.binary()), ("root", pa.binary())]))


def classes(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): a row (node, root) for each node of a link.

    Nodes are hashes, so their order is random: each round every node moves to its smallest neighbour,
    and the edges between moved nodes shrink geometrically, until one task contracts what is left. Each round is cut.
    """
    edges = cut(links.where("a != b").distinct())
    label = None
    while (count := edges.count()) > LINKS_A_TASK:
        few = -(-count // LINKS_A_TASK)  # tasks, in proportion to the links
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        up = cut(up.coalesce(few))
        label, old = _moved(label, up.withColumnRenamed("up", "root")), label
        label = cut(label)
        left, right = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))
        before, edges = edges, cut(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(few))
        for table in (before, up, *([old] if old else [])):
            forget(table)
    last = edges.coalesce(1).mapInArrow(_contract, "node binary, root binary")
    found = cut(last if label is None else _moved(label, cut(last)))
    forget(edges)
    return found


def _moved(label: DataFrame | None, up: DataFrame) -> DataFrame:
    """(node, root) of ``label``, the roots moved on by (node, root) of ``up``."""
    if label is None:
        return up
    return label.join(up.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def _alike(same, n, m):
    """Whether texts of weights n and m that share a weight of ``same`` are linked."""
    return same * (LINK[0] + LINK[1]) >= (n + m) * LINK[0]


def _near_sizes(n, m):
    return F.least(n, m) * LINK[1] >= F.greatest(n, m) * LINK[0]


def _compare_block(cell: pd.DataFrame) -> pd.DataFrame:
    """Links between the block's minor nodes and its nodes of other classes. At most a few hundred nodes come in."""
    cell = cell.sort_values(["minor", "node"])
    minor, other = cell[cell["minor"]], cell[~cell["minor"]]
    group = {r: r for r in cell["root"]}

    def find(r: bytes) -> bytes:
        while group[r] != r:
            r = group[r]
        return r

    out = []
    for a, ra, va in zip(minor["node"], minor["root"], minor["regions"], strict=True):
        for b, rb, vb in zip(other["node"], other["root"], other["regions"], strict=True):
            if find(ra) == find(rb) or min(len(va), len(vb)) * LINK[1] < max(len(va), len(vb)) * LINK[0]:
                continue
            same = len(np.intersect1d(va, vb, assume_unique=True))
            if _alike(same, len(va), len(vb)):
                out.append((a, b))
                group[find(ra)] = find(rb)
    return pd.DataFrame(out, columns=["a", "b"])


def text_hash(text_col: str) -> Column:
    return F.xxhash64(text_col, F.length(text_col))


def _grouped(members: DataFrame, buckets: DataFrame, key: str, total: int) -> DataFrame:
    """(node, nid, n, rid, lead, size): each node's groups; size is that of the largest bucket that it shares with the lead."""
    found = hot_join(members, buckets, key, total)
    return found.groupBy("node", "nid", "n", "rid", "lead").agg(F.max("size").alias("size"))


def _buckets(members: DataFrame, key: str, *more: Column) -> DataFrame:
    """(key, size, lead) of the buckets of several nodes; buckets of the same nodes are one. Sums of numbers only, so they are hashed."""
    found = members.groupBy(key).agg(
        F.count("*").alias("size"), F.min("nid").alias("lead"), F.bit_xor("nid").alias("one"), F.bit_xor(F.xxhash64("nid")).alias("two"),
        F.min("rid").alias("low"), F.max("rid").alias("high"),
    ).where("size > 1 and low < high")
    return found.groupBy("size", "one", "two").agg(F.min(key).alias(key), F.min("lead").alias("lead")).select(key, "size", "lead")


def _copy(size: str) -> Column:
    return F.ceil(F.col(size) / A_LEAD).cast("int")


def _beside_lead(grouped: DataFrame, regions: DataFrame, rid: DataFrame | None) -> DataFrame:
    """``grouped`` with a_regions, and the lead's b_node, b_regions and b_rid."""
    leads = grouped.groupBy("lead").agg(F.max("size").alias("most")).select("lead", F.explode(F.sequence(F.lit(0), _copy("most") - 1)).alias("copy"))
    own = regions.select(F.xxhash64("node").alias("lead"), F.col("node").alias("b_node"), F.col("regions").alias("b_regions"))
    if rid is not None:
        own = own.join(rid.select(F.col("node").alias("b_node"), F.col("rid").alias("b_rid")), "b_node", "left")
    else:
        own = own.withColumn("b_rid", F.lit(None).cast("bigint"))
    own = own.withColumn("b_rid", F.coalesce("b_rid", F.xxhash64("b_node")))
    near = grouped.withColumn("copy", F.pmod(F.xxhash64("node", F.lit(9)), _copy("size")).cast("int"))
    near = near.join(regions.select("node", F.col("regions").alias("a_regions")), "node")
    return near.join(own.join(leads, "lead"), ["lead", "copy"])


def _star(grouped: DataFrame, regions: DataFrame, rid: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between nodes and their leads of other classes."""
    both = _beside_lead(grouped.where("nid != lead"), regions, rid).where(F.col("rid") != F.col("b_rid"))
    n, m = F.size("a_regions"), F.size("b_regions")
    alike = both.where(_near_sizes(n, m)).where(_alike(F.size(F.array_intersect("a_regions", "b_regions")), n, m))
    return alike.select(F.col("node").alias("a"), F.col("b_node").alias("b")).distinct()


def _classed(grouped: DataFrame, root: DataFrame) -> DataFrame:
    """``grouped`` with the nodes' present classes."""
    new = root.select("node", F.xxhash64("root").alias("new"))
    return grouped.join(new, "node", "left").withColumn("rid", F.coalesce("new", "rid")).drop("new")


def _open(grouped: DataFrame) -> DataFrame:
    """The rows of groups of three or more in which several classes are left."""
    left = grouped.groupBy("lead").agg(F.count("*").alias("held"), F.min("rid").alias("low"), F.max("rid").alias("high"), F.max("size").alias("most"))
    left = left.where("held > 2 and low < high").select("lead", F.explode(F.sequence(F.lit(0), _copy("most") - 1)).alias("copy"))
    copy = F.pmod(F.xxhash64("node", F.lit(9)), _copy("size")).cast("int")
    return grouped.withColumn("copy", copy).join(left, ["lead", "copy"], "left_semi").drop("copy")


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key, size, cost) of groups of several classes: their rows, and how many pairs of nodes outside the largest class and any there are."""
    held = rows.groupBy(key, "rid").agg(F.count("*").alias("held"))
    found = held.groupBy(key).agg(F.sum("held").alias("size"), F.max("held").alias("major")).where("size > major")
    return found.select(key, "size", (F.col("size") * (F.col("size") - F.col("major"))).alias("cost"))


def _more_leads(left: DataFrame, total: int) -> DataFrame:
    """(node, nid, n, rid, lead, size): nodes of large groups beside other nodes of theirs, of other classes."""
    marks = [-(1 << 63) + (2 * k + 1) * (1 << 63) // LEADS for k in range(LEADS)]
    extra = left.groupBy("lead").agg(F.count("*").alias("size"), *(F.min(F.col("nid").bitwiseXOR(F.lit(m))).alias(f"m{k}") for k, m in enumerate(marks)))
    leads = F.array(*(F.col(f"m{k}").bitwiseXOR(F.lit(m)) for k, m in enumerate(marks)))
    extra = extra.select("lead", "size", F.explode(F.array_distinct(leads)).alias("extra"))
    extra = extra.join(left.select(F.col("nid").alias("extra"), F.col("rid").alias("extra_rid")).distinct(), "extra")
    extra = cut(extra.groupBy("lead", "size").agg(F.collect_list(F.struct("extra", "extra_rid")).alias("extras")))
    near = hot_join(left.drop("size"), extra, "lead", total).withColumn("e", F.explode("extras")).where(F.col("rid") != F.col("e.extra_rid"))
    return near.groupBy("node", "nid", "n", "rid", F.col("e.extra").alias("lead")).agg(F.max("size").alias("size"))


def _prefixes(grouped: DataFrame, regions: DataFrame) -> DataFrame:
    """(lead, node, rid, key): a row for each region of the node's prefix in its group; key stands for lead and region."""
    both = _beside_lead(grouped, regions, None)
    others, shared = F.array_except("a_regions", "b_regions"), F.array_intersect("a_regions", "b_regions")
    n = F.size("a_regions")
    least = F.ceil(n * LINK[0] / LINK[1]).cast("int")  # what a set of this size shares with one that it is alike
    first = F.slice(F.concat(F.sort_array(others), F.sort_array(shared)), F.lit(1), n - least + 1)
    rows = both.select("node", "rid", "lead", F.explode(first).alias("region"))
    return rows.select("lead", "node", "rid", F.xxhash64("lead", "region").alias("key")).distinct()


def _by_prefixes(left: DataFrame, costs: DataFrame, regions: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, node, rid) of large groups: by their prefixes where these have fewer pairs, else whole. And what was cut for it."""
    large = left.drop("size", "cost")
    large = hot_join(large, costs.withColumn("most", F.col("size")), "lead", total)
    prefixes = cut(_prefixes(large.select("node", "rid", "nid", "lead", F.col("most").alias("size")), regions))
    keys = cut(_pairs(prefixes, "key"))
    n = prefixes.count()
    found = cut(hot_join(prefixes, keys, "key", n))
    mine = found.select("key", "lead", (F.col("cost") / F.col("size")).alias("share")).groupBy("lead").agg(F.sum("share").alias("found"))
    # groups without any candidate have no row in ``mine``: nothing of them is left to compare
    whole = costs.join(mine.where("found is not null"), "lead").where("found > cost").select("lead", "size")
    sparse = costs.join(whole, "lead", "left_anti").select("lead", "size")
    by_key = hot_join(found.select("lead", "key", "node", "rid"), sparse, "lead", n)
    by_lead = hot_join(left.drop("size", "cost"), whole, "lead", total)
    out = cut(by_key.select("key", "node", "rid").unionByName(by_lead.select(F.col("lead").alias("key"), "node", "rid")))
    return out, [prefixes, keys, found]


def _blocks(left: DataFrame, regions: DataFrame) -> DataFrame:
    """Links (a, b) within buckets (key, node, rid), by comparison of all pairs of different classes but of the two largest's nodes with their own."""
    split = left.groupBy("key", "rid").agg(F.count("*").alias("held")).groupBy("key").agg(
        F.sum("held").alias("size"), F.max(F.struct("held", "rid")).alias("major"), F.sum("held").alias("all")
    ).select("key", "size", F.col("major.rid").alias("major"), (F.col("all") - F.col("major.held")).alias("minors"))
    split = cut(split)
    dealt = cut(hot_join(left.select("key", "node", "rid"), split, "key", split.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
    dealt = dealt.withColumns(
        {"rows": F.ceil(F.col("minors") / MINOR_BLOCK).cast("int"), "columns": F.ceil(F.col("size") / ALL_BLOCK).cast("int"), "root": F.col("rid").cast("string")}
    )
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    cell = ["key", "i", "j"]
    minor = dealt.where("rid != major").withColumns({"i": own("rows"), "minor": F.lit(True)}).withColumn("j", F.explode(upto("columns")))
    every = dealt.withColumns({"j": own("columns"), "minor": F.lit(False)}).withColumn("i", F.explode(upto("rows")))
    cells = minor.select(*cell, "node", "root", "minor").unionByName(every.select(*cell, "node", "root", "minor"))
    return cells.join(regions, "node").groupBy(*cell).applyInPandas(_compare_block, "a binary, b binary")


def near_duplicate_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, node, n) of every row, with ``hashed`` also its text_hash, and (node, root) of every node with a link."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketched = rows.withColumn("text_hash", text_hash("text")) if hashed else rows
    columns = "".join(f", {c} bigint" for c in BAND_COLUMNS)
    sketch = cut(sketched.mapInArrow(released(_sketch), f"id {kind}, node binary, n bigint{columns}" + ", text_hash bigint" * hashed))
    found = sketch.drop(*BAND_COLUMNS)
    nodes = sketch.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), *(F.min(c).alias(c) for c in ("n", *BAND_COLUMNS)))
    # cut before they are exploded: a row for each band would be twenty times as many
    nid = F.xxhash64("node")
    nodes = cut(nodes.withColumns({"nid": nid, "rid": nid}))
    held = nodes.select("node", "nid", "n", "rid", F.explode(F.array(*BAND_COLUMNS)).alias("key"))
    buckets = cut(_buckets(held, "key"))
    grouped = cut(_grouped(held, buckets, "key", nodes.count() * BANDS))
    forget(buckets)

    wanted = grouped.select("node").distinct().join(nodes.select("node", "id"), "node")
    ids = wanted.select(F.col("id").alias("wanted")).distinct()
    texts = rows.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    regions = texts.mapInArrow(released(_regions), "node binary, regions array<bigint>").join(wanted.select("node"), "node", "left_semi")
    regions = cut(regions.groupBy("node").agg(F.first("regions").alias("regions")))
    forget(nodes)

    links = cut(_star(grouped, regions))
    root = classes(links)
    # groups in which several classes are left
    left = cut(_open(_classed(grouped, root)))
    forget(grouped)
    made = [regions, left]
    total = left.count()
    costs = cut(_pairs(left, "lead"))
    if not costs.where(F.col("cost") > DIRECT).isEmpty():
        large = hot_join(left.drop("size"), costs.where(F.col("cost") > DIRECT), "lead", total)
        links = cut(links.unionByName(_star(_more_leads(large, total), regions, left.select("node", "rid").distinct())))
        root = classes(links)
        made += [left := cut(_open(_classed(left, root))), costs]
        costs = cut(_pairs(left, "lead"))
    made.append(costs)
    small, large = costs.where(F.col("cost") <= DIRECT), costs.where(F.col("cost") > DIRECT)
    blocks = [cut(hot_join(left.drop("size"), small, "lead", total).select(F.col("lead").alias("key"), "node", "rid"))]
    if not large.isEmpty():
        more, used = _by_prefixes(left, large, regions, total)
        blocks, made = [*blocks, more], [*made, *used]
    made += blocks
    blocks = [b for b in blocks if not b.isEmpty()]
    for b in blocks:
        links = links.unionByName(_blocks(b, regions))
    if blocks:
        root = classes(links)
    for table in made:
        forget(table)
    return found, root


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, class_id (the smallest id of its class) and class_size."""
    rows, root = near_duplicate_nodes(docs, id_col, text_col)
    per_node = rows.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    rooted = cut(per_node.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = rooted.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"))
    named = cut(rooted.join(named, "root").select("node", "class_id", "class_size"))
    out = rows.join(named, "node")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one row of each class; columns as before.

    Kept is the row of the smallest id (null ids last), of equal ids that of the smallest node, then of the smallest text hash.
    Rows that repeat both id and text are one row.
    """
    rows, root = near_duplicate_nodes(docs, id_col, text_col, hashed=True)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node", "text_hash")
    per_node = rows.groupBy("node").agg(F.min(order).alias("low"))
    rooted = cut(per_node.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    kept = rooted.groupBy("root").agg(F.min("low").alias("kept"))
    kept = cut(rooted.join(kept, "root").select("node", F.col("kept.id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash")))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    gone = rows.join(kept, "node").where(~same).select(F.col("id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct()
    whole = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text"), F.struct("*").alias("row"))
    left = whole.join(gone, _is("gone", "gone_hash"), "left_anti")
    repeated = cut(rows.groupBy("id", "text_hash").count().where("count > 1").select(F.col("id").alias("again"), F.col("text_hash").alias("again_hash")))
    if repeated.isEmpty():  # no text has to be shuffled to find equal rows
        return left.select("row.*")
    once, more = (left.join(repeated, _is("again", "again_hash"), how) for how in ("left_anti", "left_semi"))
    return once.select("row.*").unionByName(more.dropDuplicates(["id", "text"]).select("row.*"))


def _is(id_col: str, hash_col: str) -> Column:
    return F.col("id").eqNullSafe(F.col(id_col)) & (F.col("text") == F.col(hash_col))
