"""Join of near-duplicate texts: Jaccard similarity of 5-word shingles of `threshold` or more, found by a MinHash LSH forest.

Texts with equal shingle sets are one class.  Classes enter `TREES` prefix tries of min-hash labels: each trie is its labels in sorted
order, and a node is a run of labels with a common prefix.  Matching starts from full labels.  How often pairs of each (sketched) similarity
s meet there tells how many such pairs there are, for one pair meets in TREES * s**DEPTH tries; prefixes are then shortened
to the longest length at which the forest is to find `recall` of those pairs.  A node of more than HOT members, or one that a range of the
sorted labels ends in, is a list of blocks, and its blocks are compared one with another in tasks of their own, so nothing is left out.

Members of a node whose sketches agree well enough are candidates.  Candidate groups (connected candidates) of up to `block` members
are verified exactly, each pair.  Larger groups are cut into blocks of neighbours, and only those pairs of blocks
that met in some node are verified, each pair of texts in them.  No list of pairs of texts is ever made: a task counts the links of each text
and keeps one edge from each text to its root.

Result: one row for each row of docs with class_id (smallest id of the group of texts connected by links), exact_id (smallest id with
an equal shingle set) and n_links (other documents at or above the threshold, equal ones included).

Defined cases: words are separated by ASCII white space; a text of 1 to 4 words has one shingle, all of it; null, empty and blank texts
have none and link to nothing, as do rows with a null id (class_id and exact_id null).  Repeated rows of one id and one shingle set
are one document; rows of one id with different shingle sets are a document each.  Texts of any length are compared whole.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import mix, rows
from skein.operators.components import connected_components
from skein.session import cut

WIDTH, TREES, DEPTH = 5, 16, 6
N_HASHES = TREES * DEPTH
_draw = np.random.default_rng(20240101)
MULTIPLY = _draw.integers(1, 2**63, N_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _draw.integers(0, 2**63, N_HASHES, np.uint64)
#: Members of a node that are compared at once; members and shingles of a block.
HOT, BLOCK, MOST_SHINGLES = 4096, 2048, 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _Hashes()


def shingles(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, as ascending 64-bit hashes."""
    words = (data or b"").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(width, len(h))))
    for k in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def print_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def min_hashes(s: np.ndarray) -> np.ndarray:
    out = np.full(N_HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(s), 512):
        out = np.minimum(out, (s[at : at + 512, None] * MULTIPLY + ADD).min(0))
    return mix(out)


def found_at(similarity: float, depth: int) -> float:
    """The probability that a pair meets in some trie at prefixes of `depth`."""
    return 1 - (1 - similarity**depth) ** TREES


def depth_for(met: dict[int, float], threshold: float, recall: float) -> int:
    """The longest prefix at which the forest is to find `recall` of the pairs at the threshold or above.

    met: how often pairs with so many different sketch bits met at full labels.  Ten pairs at the threshold itself are added, so that few
    sightings do not decide alone; pairs whose sketches differ more than two deviations beyond the threshold's are not counted."""
    expected = N_HASHES * (1 - threshold) / 2
    most = expected + 2 * (expected * (1 + threshold) / 2) ** 0.5
    pairs = Counter({threshold: 10.0})
    for differ, times in met.items():
        if differ <= most:
            s = min(1.0, max(threshold, 1 - 2 * differ / N_HASHES))
            pairs[s] += times / (TREES * s**DEPTH)
    total = sum(pairs.values())
    return max((p for p in range(1, DEPTH + 1) if sum(n * found_at(s, p) for s, n in pairs.items()) >= recall * total), default=1)


SKETCH = "doc_id long, text_hash long, fp binary, labels binary, bits binary, n long"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and size of the shingle set, trie labels (2 bytes a level) and a sketch of one bit for each hash."""
    for batch, texts in rows(batches):
        out: list[tuple] = []
        for data in texts:
            s = shingles(data)
            if len(s):
                m = min_hashes(s)
                bits = np.packbits((m >> np.uint64(40) & np.uint64(1)).astype(np.uint8)).tobytes()
                out.append((print_of(s), (m & np.uint64(0xFFFF)).astype(">u2").tobytes(), bits, len(s)))
            else:
                out.append((None, None, None, 0))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, pa.binary()) for c in cols[:3]), pa.array(cols[3], pa.int64())], ["doc_id", "text_hash", "fp", "labels", "bits", "n"])


def entries(classes: DataFrame) -> DataFrame:
    """key (tree and label), node and bits: one row for each class and tree."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    every = classes.select("node", "labels", "bits", tree)
    return every.select(F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.substring("labels", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))).alias("key"), "node", "bits")


def _root(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _join(parent: list[int], pairs: Iterator[tuple[int, int]]) -> None:
    for a, b in pairs:
        a, b = _root(parent, a), _root(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)


def near_roots(bits: list[bytes], differ: int) -> list[int]:
    """The root of each sketch, those with at most `differ` different bits being joined.  Every pair is compared, but for pairs already joined."""
    parent = list(range(len(bits)))
    if len(bits) <= 6:
        x = [int.from_bytes(b, "big") for b in bits]
        _join(parent, ((a, b) for a in range(len(x)) for b in range(a) if (x[a] ^ x[b]).bit_count() <= differ))
    else:
        sketch = np.frombuffer(b"".join(bits), np.uint32).reshape(len(bits), -1)
        sketch, first, where = np.unique(sketch, axis=0, return_index=True, return_inverse=True)
        _join(parent, ((k, int(first[w])) for k, w in enumerate(where.reshape(-1))))
        left = np.arange(len(sketch))
        while len(left) > 1:  # spread from one member at a time; what is joined needs no more comparing among itself
            seeds, left = [left[0]], left[1:]
            head = int(first[seeds[0]])
            while seeds and len(left):
                near = np.zeros(len(left), bool)
                for s in seeds[:64]:
                    near |= np.bitwise_count(sketch[left] ^ sketch[s]).sum(1) <= differ
                new, left = left[near], left[~near]
                _join(parent, ((head, int(first[x])) for x in new))
                seeds = [*seeds[64:], *new]
    return [_root(parent, k) for k in range(len(bits))]


def _count_pairs(bits: list[bytes], met: Counter, seeds: int = 32) -> None:
    """Adds how many pairs of a node have each number of different bits; of a crowded node `seeds` members stand for all (this only chooses the depth)."""
    if len(bits) <= 6:
        x = [int.from_bytes(b, "big") for b in bits]
        met.update((x[a] ^ x[b]).bit_count() for a in range(len(x)) for b in range(a))
        return
    sketch = np.frombuffer(b"".join(bits), np.uint32).reshape(len(bits), -1)
    own = np.unique(np.linspace(0, len(bits) - 1, min(seeds, len(bits))).astype(int))
    for s in own:
        apart = np.bincount(np.bitwise_count(np.delete(sketch, s, 0) ^ sketch[s]).sum(1))
        for d in np.flatnonzero(apart).tolist():
            met[d] += float(apart[d]) * len(bits) / (2 * len(own))


MATCH = "u long, v long, prefix binary, block long, bits binary, differ int, times double"


def _match(depth: int, differ: int, hot: int):
    """Edges (u, v) between near members of a node; the members of nodes that are lists of blocks; and, of full labels, what pairs met."""
    size = 1 + 2 * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        out: list[tuple] = []
        met: Counter = Counter()
        blocks = 0

        def close(prefix: bytes, nodes: list[int], bits: list[bytes], divided: bool) -> None:
            nonlocal blocks
            if len(nodes) > 1:
                out.extend((nodes[k], nodes[r], None, None, None, None, None) for k, r in enumerate(near_roots(bits, differ)) if r != k)
                if depth == DEPTH:
                    _count_pairs(bits, met)
            if divided:
                out.extend((n, None, prefix, base + blocks, b, None, None) for n, b in zip(nodes, bits, strict=True))
                blocks += 1

        def written() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.float64())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["u", "v", "prefix", "block", "bits", "differ", "times"])

        prefix, nodes, bits, divided = b"", [], [], True  # the first run may have begun in the range before
        for batch in batches:
            for key, node, b in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "bits")), strict=True):
                if key[:size] != prefix:
                    if nodes:
                        close(prefix, nodes, bits, divided)
                        divided = False
                    prefix, nodes, bits = key[:size], [], []
                elif len(nodes) >= hot:
                    divided = True
                    close(prefix, nodes, bits, True)
                    nodes, bits = [], []
                nodes.append(node)
                bits.append(b)
            if len(out) > 20_000:
                yield written()
        if nodes:
            close(prefix, nodes, bits, True)  # and the last may go on in the next
        out.extend((None, None, None, None, None, d, float(n)) for d, n in met.items())
        yield written()

    return run


def _across(differ: int):
    """Edges between near members of two blocks of a node, which are near within their own blocks already."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        nodes, bits = table.column("u").to_pylist(), table.column("bits").to_pylist()
        edges = [(nodes[k], nodes[r]) for k, r in enumerate(near_roots(bits, differ)) if r != k]
        return pa.table({"u": pa.array([a for a, _ in edges], pa.int64()), "v": pa.array([b for _, b in edges], pa.int64())})

    return run


def block_pairs(blocks: DataFrame, by: list[str], same: bool) -> DataFrame:
    """The pairs i <= j (i < j unless `same`) of the blocks that stand in one node; blocks has the columns `by` and block."""
    own = blocks.select(*by, "block").distinct()
    return own.withColumnRenamed("block", "i").join(own.withColumnRenamed("block", "j"), by).filter(F.col("i") <= F.col("j") if same else F.col("i") < F.col("j"))


def in_pairs(members: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """members (with `by` and block) once for each pair (i, j) that has their block."""
    sides = pairs.select(*by, F.col("i").alias("block"), "i", "j").unionAll(pairs.filter("i <> j").select(*by, F.col("j").alias("block"), "i", "j"))
    return members.join(sides, [*by, "block"])


def candidates(forest: DataFrame, threshold: float, recall: float, differ: int, hot: int = HOT) -> tuple[DataFrame, int]:
    """Edges (src, dst) that connect each node with all nodes that are near it in some trie node, and the prefix length.  forest: as entries() gives, in ranges of sorted keys."""
    found = cut(forest.mapInArrow(_match(DEPTH, differ, hot), MATCH))
    depth = depth_for({r.differ: r.times for r in found.filter("differ is not null").groupBy("differ").agg(F.sum("times").alias("times")).collect()}, threshold, recall)
    if depth < DEPTH:
        found = cut(forest.mapInArrow(_match(depth, differ, hot), MATCH))
    blocks = found.filter("prefix is not null").select("prefix", "block", "u", "bits")
    across = in_pairs(blocks, block_pairs(blocks, ["prefix"], same=False), ["prefix"]).select("prefix", "i", "j", "u", "bits").groupBy("prefix", "i", "j").applyInArrow(_across(differ), "u long, v long")
    return found.filter("v is not null").select("u", "v").unionAll(across).toDF("src", "dst"), depth


def blocks_of(groups: DataFrame, size: DataFrame, block: int, most: int) -> DataFrame:
    """(comp, node, block): each group dealt out into blocks of about `block` members and `most` shingles at most, neighbours in the first trie together where they fit.

    A group is cut by the value of its members' first min-hash; what still holds too much (a value that most members share) is dealt out by a hash."""
    fits = lambda members, n: F.greatest(F.ceil(F.col(members) / block), F.ceil(F.col(n) / most))
    first = F.conv(F.hex(F.substring("labels", 1, 2)), 16, 10).cast("long")
    cut_up = groups.join(size, "comp").withColumn("part", F.floor(first * fits("members", "shingles") / 65536))
    held = cut_up.groupBy("comp", "part").agg(F.count("*").alias("own"), F.sum("n").alias("own_shingles")).select("comp", "part", fits("own", "own_shingles").alias("deals"))
    return cut_up.join(held, ["comp", "part"]).select("comp", "node", (F.col("part") * (1 << 24) + F.pmod(F.xxhash64("node"), F.col("deals"))).alias("block"))


def to_verify(groups: DataFrame, classes: DataFrame, depth: int, block: int, most: int) -> DataFrame:
    """(comp, i, j, block, node): the members of each pair of blocks that is to be verified."""
    groups = cut(groups.join(classes.select("node", "n", "labels"), "node"))
    size = groups.groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    large = (F.col("members") > block) | (F.col("shingles") > most)
    whole = groups.join(size.filter(~large), "comp").select("comp", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(-1).cast("long").alias("block"), "node")
    blocks = cut(blocks_of(groups, size.filter(large), block, most))
    if blocks.isEmpty():
        return whole
    of_nodes = entries(classes.join(blocks.select("node"), "node", "left_semi")).select(F.substring("key", F.lit(1), F.lit(1 + 2 * depth)).alias("prefix"), "node").join(blocks, "node")
    pairs = block_pairs(of_nodes, ["prefix", "comp"], same=True).select("comp", "i", "j").distinct()
    return whole.unionAll(in_pairs(blocks, pairs, ["comp"]).select("comp", "i", "j", "block", "node"))


def verified(sets: list[np.ndarray], sizes: list[int], left: int, cross: bool, top: int, bottom: int) -> tuple[list[int], list[int]]:
    """Links of each text, weighted by the sizes of the classes linked to, and its root.  A pair is a link if bottom * |a & b| >= top * |a | b|.
    cross: only pairs of the first `left` texts with the others."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    start = np.searchsorted(inverse[order], np.arange(len(values) + 1))
    length = np.array([len(s) for s in sets])
    weight = np.array(sizes)
    links, parent = np.zeros(n, np.int64), list(range(n))
    offset = np.concatenate(([0], np.cumsum(length)))
    for a in range(left if cross else n):
        own = inverse[offset[a] : offset[a + 1]]
        count = start[own + 1] - start[own]
        at = np.repeat(start[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(posting[at], minlength=n)
        near = bottom * both >= top * (length + length[a] - both)
        near[: left if cross else a + 1] = False
        hit = np.flatnonzero(near)
        if len(hit):
            links[a] += weight[hit].sum()
            links[hit] += weight[a]
            _join(parent, ((a, int(b)) for b in hit))
    return links.tolist(), [_root(parent, k) for k in range(n)]


def _texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of rep, without the repeated rows of one node and text."""
    last, seen = None, set()
    for batch in batches:
        keep = []
        for rep, node, text in zip(batch.column("rep").to_pylist(), batch.column("node").to_pylist(), batch.column("text_hash").to_pylist(), strict=True):
            if rep != last:
                last, seen = rep, set()
            keep.append((node, text) not in seen)
            seen.add((node, text))
        yield batch.filter(pa.array(keep, pa.bool_()))


def _verify(top: int, bottom: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("comp", "i", "j", "block", "node", "fp", "size")}
        texts = table.column("text").cast(pa.binary()).to_pylist()
        groups: dict[tuple, dict[int, int]] = {}
        known: dict[int, np.ndarray] = {}
        for k, g in enumerate(zip(cols["comp"], cols["i"], cols["j"], strict=True)):
            node = cols["node"][k]
            if node not in known and print_of(s := shingles(texts[k])) == cols["fp"][k]:  # else another text of that id
                known[node] = s
            if node in known:
                groups.setdefault(g, {})[node] = k
        nodes, links, root = [], [], []
        for (_, i, j), at in groups.items():
            own = sorted(at.values(), key=lambda k: (cols["block"][k] != i, cols["node"][k]))
            names = [cols["node"][k] for k in own]
            n, r = verified([known[x] for x in names], [cols["size"][k] for k in own], sum(cols["block"][k] == i for k in own), i != j, top, bottom)
            nodes += names
            links += n
            root += [names[x] for x in r]
        return pa.table({"node": pa.array(nodes, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    return run


def join(docs: DataFrame, top: int = 4, bottom: int = 5, recall: float = 0.9995, block: int = BLOCK, most: int = MOST_SHINGLES, pack_shingles: int = 500_000, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, exact_id, n_links for each row of docs; the threshold is top / bottom."""
    return _joined(docs, top, bottom, recall, block, most, pack_shingles, hot, id_col, text_col).drop("text_hash")


def _joined(docs: DataFrame, top: int = 4, bottom: int = 5, recall: float = 0.9995, block: int = BLOCK, most: int = MOST_SHINGLES, pack_shingles: int = 500_000, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    agree = (1 + top / bottom) / 2  # of one-bit sketches at the threshold
    differ = int(N_HASHES * (1 - agree) + 4.5 * (N_HASHES * agree * (1 - agree)) ** 0.5)
    sketches = cut(own.select("doc_id", "text_hash", "text").mapInArrow(_sketch, SKETCH))
    each = sketches.filter("fp is not null and doc_id is not null")
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("size"), F.first("labels").alias("labels"), F.first("bits").alias("bits"), F.first("n").alias("n"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers hold, since what is read is what was written
    edges, depth = candidates(entries(classes).repartitionByRange("key", "node").sortWithinPartitions("key", "node"), top / bottom, recall, differ, hot)
    work = cut(to_verify(connected_components(edges), classes, depth, block, most))
    shipped = work.join(classes.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-shipped // pack_shingles))

    members = classes.select("node", "rep", "fp", "size").join(work.select("node").distinct(), "node")
    texts = own.filter("doc_id is not null").join(members, own.doc_id == members.rep).select("rep", "node", "fp", "size", "text_hash", "text").mapInArrow(_texts_once, "rep long, node long, fp binary, size long, text_hash long, text string")
    packed = texts.join(work, "node").select(F.pmod(F.xxhash64("comp", "i", "j"), F.lit(packs)).alias("pack"), "comp", "i", "j", "block", "node", "fp", "size", "text")
    found = cut(packed.groupBy("pack").applyInArrow(_verify(top, bottom), "node long, links long, root long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = classes.select("node", "fp", "rep", "size").join(links, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = cut(named.select("comp", "fp", "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    of_class = named.join(named.groupBy("comp").agg(F.min("rep").alias("class_id")), "comp").select("fp", "rep", "n_links", "class_id")
    out = sketches.select("doc_id", "text_hash", "fp").join(of_class, "fp", "left")
    linked = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", F.when(linked, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(linked, F.coalesce("rep", "doc_id")).alias("exact_id"), F.when(linked, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those whose text shares a class with a smaller id.  Repeated rows of one id and text stay together."""
    gone = cut(_joined(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_text")).distinct())
    return docs.join(gone, (docs["doc_id"] == gone["gone"]) & (F.xxhash64(docs["text"]) == gone["gone_text"]), "left_anti")


def op8_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return join(docs)
