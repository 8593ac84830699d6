"""SimHash near-duplicates found by vantage-point trees over Hamming distance.

A document's fingerprint is the bitwise majority of the XXH64 values (seed 42)
of its shingles. Distinct fingerprints go down a vantage-point tree built from a
bounded sample: at a node with vantage point v and radius r, those within r of v
are at home on the near side, the others on the far side. A fingerprint whose
ball of radius ``max_bits`` crosses the sphere also visits the other side as a
guest, so every linked pair meets in some leaf (triangle inequality; exact). In
a leaf the same recursion goes on in memory down to small blocks. A leaf task
keeps a spanning forest of its links, and the forests are joined into components.

A leaf far larger than the mean, or than a task can hold, is split by further
vantage points from a sample of its own. What no point separates (a swarm of near
copies closer than the radius can tell apart) is dealt into blocks and every pair
of blocks is a task of its own. Documents with equal fingerprints are one vertex throughout.

Rows: a null or wordless text has fingerprint zero and is linked like any other.
Ties and repeated rows share a vertex; repeated ids keep their rows. Rows with a
null id are linked like others and have the component of their fingerprint, which
is null if no id is in it. Other columns are never read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components, least_of_each
from quillspark.llm.scratch import stored

SEED = 42
SAMPLE = 8192
#: A fingerprint visits more leaves the more there are, and leaves hold more rows the fewer: their number grows with the root.
LEAVES_OF_ROOT = 1 / 8
LEAST_LEAVES, MOST_LEAVES = 16, 8192
#: Rows of a leaf that one task can hold, and how often leaves of more (or of twice the mean) are split by further vantage points.
LEAF_ROWS, SPLITS = 1 << 20, 2
BLOCK = 64


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit fingerprint of a whole text by shingles of ``width`` words (fewer words: all of them)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes - 1
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), 255 << 8):
        bits = np.unpackbits(values[i : i + (255 << 8)].view(np.uint8), bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (255 * 64))).reshape(-1, 255, 64)
        ones += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # at most 255 ones fit a byte
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp as signed long) of every row; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter((fingerprint(t, width) for t in pdf[text]), np.uint64, len(pdf))
            yield pd.DataFrame({key: pdf[key], "fp": fp.view(np.int64)})

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


class Node:
    """A split: vantage point, radius, near and far subtrees; a leaf has only its number."""

    __slots__ = ("leaf", "vantage", "radius", "near", "far")

    def __init__(self, leaf: int = -1):
        self.leaf, self.vantage, self.radius, self.near, self.far = leaf, None, 0, None, None


def _vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The candidate whose distances spread most and its median distance; None if no candidate splits the points."""
    best, found = 0.0, None
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = np.bitwise_count(points ^ v)
        radius = int(np.median(d))
        if radius >= d.max():
            radius = int(d.max()) - 1
        near = np.count_nonzero(d <= radius)
        if 0 < near < len(points) and (spread := float(d.std()) * min(near, len(points) - near)) > best:
            best, found = spread, (v, radius)
    return found


def build_tree(sample: np.ndarray, leaves: int, root: Node | None = None, number: int = 0) -> Node:
    """A tree of about ``leaves`` leaves, numbered from ``number`` on, over a sample of distinct fingerprints; the largest part is split first."""
    root = root or Node()
    parts = [(root, sample)]
    stuck = []
    while parts and len(parts) + len(stuck) < leaves:
        parts.sort(key=lambda p: len(p[1]))
        node, points = parts.pop()
        if len(points) < 4 or (split := _vantage(points)) is None:
            stuck.append((node, points))
            continue
        node.vantage, node.radius = split
        near = np.bitwise_count(points ^ node.vantage) <= node.radius
        node.leaf, node.near, node.far = -1, Node(), Node()
        parts += [(node.near, points[near]), (node.far, points[~near])]
    for i, (node, _) in enumerate(parts + stuck):
        node.leaf = number + i
    return root


def leaves_of(root: Node) -> dict[int, Node]:
    found, stack = {}, [root]
    while stack:
        node = stack.pop()
        if node.leaf >= 0:
            found[node.leaf] = node
        else:
            stack += [node.near, node.far]
    return found


def route(root: Node, fp: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, places in ``fp``, whether they are guests) for all leaves that they reach."""
    everyone = np.arange(len(fp))
    stack = [(root, everyone, everyone[:0])]
    while stack:
        node, home, guest = stack.pop()
        if node.leaf >= 0:
            if len(home):
                yield node.leaf, home, False
            if len(guest):
                yield node.leaf, guest, True
            continue
        dh = np.bitwise_count(fp[home] ^ node.vantage).astype(np.int64)
        dg = np.bitwise_count(fp[guest] ^ node.vantage).astype(np.int64)
        near = dh <= node.radius
        crossing = ~near & (dh <= node.radius + max_bits)
        stack.append((node.far, home[~near], guest[dg > node.radius - max_bits]))
        stack.append((node.near, home[near], np.concatenate((home[crossing], guest[dg <= node.radius + max_bits]))))


class Forest:
    """Union-find over places, fed with arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])
            np.minimum.at(self.parent, a, b)


def link_within(fp: np.ndarray, home: np.ndarray, guest: np.ndarray, max_bits: int, forest: Forest) -> None:
    """Link all pairs within ``max_bits`` among ``home`` and between ``home`` and ``guest``."""
    stack = [(home, guest)]
    while stack:
        home, guest = stack.pop()
        if not len(home) or len(home) + len(guest) < 2:
            continue
        split = _vantage(fp[home]) if len(home) > BLOCK else None
        if split is None:
            others = np.concatenate((home, guest))
            for low in range(0, len(home), BLOCK):
                mine = home[low : low + BLOCK]
                rest = others[low:]
                for at in range(0, len(rest), 1 << 16):
                    some = rest[at : at + (1 << 16)]
                    i, j = np.nonzero(np.bitwise_count(fp[mine][:, None] ^ fp[some][None, :]) <= max_bits)
                    forest.link(mine[i], some[j])
            continue
        vantage, radius = split
        dh = np.bitwise_count(fp[home] ^ vantage).astype(np.int64)
        dg = np.bitwise_count(fp[guest] ^ vantage).astype(np.int64)
        near = dh <= radius
        crossing = ~near & (dh <= radius + max_bits)
        stack.append((home[~near], guest[dg > radius - max_bits]))
        stack.append((home[near], np.concatenate((home[crossing], guest[dg <= radius + max_bits]))))


def links(vertices: DataFrame, max_bits: int = 3, sample_rows: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints of ``vertices`` (node).

    ``vertices`` is read several times and should be a stored table.
    """
    total = vertices.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = vertices.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).collect()  # about sample_rows
    sample = np.unique(np.array([r.node for r in drawn], np.int64).view(np.uint64))
    tree = build_tree(sample, min(max(LEAST_LEAVES, int(total**0.5 * LEAVES_OF_ROOT)), MOST_LEAVES))

    def dealt_by(tree: Node) -> DataFrame:
        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                node = pdf["node"].to_numpy()
                for leaf, at, guest in route(tree, node.view(np.uint64), max_bits):
                    yield pd.DataFrame({"leaf": np.int32(leaf), "guest": guest, "node": node[at]})

        return vertices.mapInPandas(deal, "leaf int, guest boolean, node long")

    for last in (*[False] * SPLITS, True):
        dealt = dealt_by(tree)
        counts = {r.leaf: r.n for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf
        fair = min(max(2 * sum(counts.values()) // max(len(counts), 1), 256), leaf_rows)
        large = {leaf: n for leaf, n in counts.items() if n > fair}
        if last or not large or not _split(tree, large, dealt, fair, sample_rows):
            break
    if large:
        blocks = dealt.sparkSession.createDataFrame([(leaf, -(-2 * n // fair)) for leaf, n in large.items()], "of int, g int")  # at most a row a leaf
        g = F.coalesce("g", F.lit(1))
        mine = F.pmod(F.xxhash64("node", F.lit(7)), g).cast("int")
        pair = F.transform(F.filter(F.sequence(F.lit(0), g - 1), lambda i: i != mine), lambda i: F.struct(F.least(i, mine).alias("i"), F.greatest(i, mine).alias("j")))
        placed = dealt.join(F.broadcast(blocks), F.col("leaf") == F.col("of"), "left")
        dealt = placed.select("leaf", "guest", "node", F.explode(F.when(g == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pair)).alias("part"))
    else:
        dealt = dealt.withColumn("part", F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        node, guest = pdf["node"].to_numpy(), pdf["guest"].to_numpy().astype(bool)
        forest = Forest(len(node))
        link_within(node.view(np.uint64), np.flatnonzero(~guest), np.flatnonzero(guest), max_bits, forest)
        root = forest.roots(np.arange(len(node)))
        linked = root != np.arange(len(node))
        return pd.DataFrame({"a": node[linked], "b": node[root[linked]]})

    return dealt.groupBy("leaf", "part").applyInPandas(search, "a long, b long")


def _split(tree: Node, large: dict[int, int], dealt: DataFrame, fair: int, sample_rows: int) -> bool:
    """Split leaves of too many rows by further vantage points, chosen from a sample of those that are at home there; whether any could be."""
    leaves, number, done = leaves_of(tree), max(leaves_of(tree)) + 1, False
    rows = sum(large.values())
    share = int(min(1.0, sample_rows / rows) * (1 << 30))
    drawn = dealt.where(F.col("leaf").isin(list(large)) & ~F.col("guest") & (F.pmod(F.xxhash64("node", F.lit(number)), F.lit(1 << 30)) < share)).select("leaf", "node").collect()
    points: dict[int, list[int]] = {}
    for r in drawn:
        points.setdefault(r.leaf, []).append(r.node)
    for leaf, some in points.items():
        sample = np.unique(np.array(some, np.int64).view(np.uint64))
        build_tree(sample, -(-2 * large[leaf] // fair), leaves[leaf], number)
        if leaves[leaf].leaf < 0:
            number, done = number + len(leaves_of(leaves[leaf])), True
        else:
            leaves[leaf].leaf = leaf
    return done


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp, component_id (the smallest key that links reach, the document's own included) for every row."""
    prints = stored(fingerprints(docs, width, key, text))
    vertices = stored(prints.groupBy(F.col("fp").alias("node")).agg(F.min(key).alias(key)))
    labels = components(links(vertices.select("node"), max_bits))
    classes = stored(least_of_each(vertices, labels, key))
    return prints.join(classes, F.col("fp") == F.col("node")).select(key, "fp", "component_id")


def hexadecimal(fp) -> F.Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

