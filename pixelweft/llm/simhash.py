"""SimHash near-duplicates: fingerprints, a generalised pigeonhole search, components of its links.

`near_duplicates` links documents by the distance of their fingerprints. `similar_groups` links them by the Jaccard
similarity of their word shingles: the same search gives candidates, fingerprints of parts of the shingle set give
those whose fingerprints are further apart, and every link is verified on the whole sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.plans.fixpoint import connected_components, files_for

from .common import batches, materialize, mix64, prefix_hash, span_hash

BITS = 64
#: Parts of a shingle set that get fingerprints for each range of sizes, at most.
PARTS = 24
#: A probe row costs about a microsecond to make and move, a candidate pair some nanoseconds to verify.
PROBE_COST, VERIFY_COST = 1.0, 0.02
BRUTE = 4096
#: Fingerprints of a bucket that one task searches.
CROWD = 200_000


# --- fingerprints ----------------------------------------------------------------------------------------------------


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Majority of the bits of the XXH64 hashes (seed 42) of all word shingles; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    ends = (starts[min(width, len(words)) :] - 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends, strict=True)], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): a signed long with the fingerprint's 64 bits. A null text counts as an empty one."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fps = [fingerprint(t, width) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["__key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("__key"), F.col(text)).mapInArrow(run, f"__key {kind}, fp long").withColumnRenamed("__key", key)


# --- partitions and thresholds ---------------------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each two bits are set: over all of them, summed in place."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in source:
            h = np.asarray(batch.column(0)).astype(np.int64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 20):
                total += np.rint(bits[at : at + (1 << 20)].T @ bits[at : at + (1 << 20)]).astype(np.int64)
            n += len(h)
        if n:
            i, j = np.indices((BITS, BITS)).reshape(2, -1)
            yield pa.record_batch([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), n))], ["i", "j", "n"])

    out, n = np.zeros((BITS, BITS)), 0
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            n = r.n
        else:
            out[r.i, r.j] = r.n
    return n, out


def group_bits(n: int, counts: np.ndarray, parts: int) -> list[list[int]]:
    """Bits that go together in one partition: greedy by the correlation with the bits that are already in it."""
    mean = counts.diagonal() / max(1, n)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    strength = np.abs(counts / max(1, n) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    rest, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [max(sorted(rest), key=lambda b: strength[b, sorted(rest)].sum())]
        rest.discard(own[0])
        while len(own) < size:
            own.append(max(sorted(rest), key=lambda b: strength[b, own].sum()))
            rest.discard(own[-1])
        out.append(sorted(own))
    return out


def allocate(pairs: list[float], widths: list[int], n: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 at the least estimated cost, by dynamic programming.

    By the general pigeonhole principle two fingerprints within the radius differ in at most t_i bits of some
    partition i; -1 leaves a partition out. pairs: how many pairs agree in all bits of a partition, counted over all
    fingerprints; each way to differ in t bits is taken to add as many.
    """

    def cost(i: int, t: int) -> float:
        ways = sum(comb(widths[i], k) for k in range(t + 1))
        return ways * (max(1, n) * PROBE_COST + pairs[i] * VERIFY_COST)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(widths)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, min(radius - used, widths[i]) + 1):
                now = (c + cost(i, t), [*ts, t])
                if used + t + 1 not in step or now < step[used + t + 1]:
                    step[used + t + 1] = now
        best = step
    return best[radius + 1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan_search(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds: the cheapest of several counts of partitions."""
    n, counts = bit_counts(fps)
    schemes = [group_bits(n, counts, m) for m in range(2, radius + 2)]
    flat = [(k, i, bits) for k, scheme in enumerate(schemes) for i, bits in enumerate(scheme)]
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits)))).alias("v")) for k, i, bits in flat]))
    agree = fps.select(values.alias("x")).groupBy("x.k", "x.i", "x.v").count().groupBy("k", "i").agg(F.sum((F.col("count") * F.col("count")).cast("double")).alias("pairs"))
    found = {(r.k, r.i): r.pairs for r in agree.collect()}
    best = min((allocate([found.get((k, i), 0.0) for i in range(len(s))], [len(b) for b in s], n, radius)[0], k) for k, s in enumerate(schemes))[1]
    _, ts = allocate([found.get((best, i), 0.0) for i in range(len(schemes[best]))], [len(b) for b in schemes[best]], n, radius)
    return [(bits, t) for bits, t in zip(schemes[best], ts, strict=True) if t >= 0]


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): a partition's value of each fingerprint, with up to t of its bits turned over."""
    keys = []
    for part, (bits, t) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        for k in range(t + 1):
            for turned in combinations(bits, k):
                keys.append(F.struct(F.lit(part).alias("part"), value.bitwiseXOR(F.lit(signed(sum(1 << b for b in turned)))).alias("key")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.part", "x.key", "fp")


# --- verification ----------------------------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect: each node but the least of its component, with that one."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def link_group(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over all links among the distinct fingerprints of one bucket."""
    if len(fps) > BRUTE and radius >= 1:
        return link_dense(fps, radius)
    a, b = fps[:0], fps[:0]
    for at in range(0, len(fps), 256):
        i, j = np.nonzero(near(fps[at : at + 256, None], fps[None, at:], radius))
        a, b = forest(np.concatenate([a, fps[at + i][i != j]]), np.concatenate([b, fps[at + j][i != j]]))
    return a, b


def link_dense(fps: np.ndarray, radius: int, room: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """The same without comparing all pairs, for buckets that hold a large group of near copies.

    Two fingerprints within the radius meet at a word that is at most radius // 2 bits from one and at most the rest
    from the other. All that are that near a word are linked to the least of those at the shorter distance; whatever
    so meets is within the radius. Words are dealt over rounds by a hash, so memory stays bounded.
    """
    low, high = radius // 2, radius - radius // 2
    turns = [sum(1 << b for b in c) for k in range(high + 1) for c in combinations(range(BITS), k)]
    inner = sum(comb(BITS, k) for k in range(low + 1))
    rounds = -(-len(turns) * len(fps) // room)
    a, b = fps[:0], fps[:0]
    for r in range(rounds):
        words, owner, first = [], [], []
        for k, turn in enumerate(turns):
            w = fps ^ np.uint64(turn)
            at = np.flatnonzero((w * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(rounds) == r)
            words.append(w[at])
            owner.append(at)
            first.append(np.full(len(at), k >= inner))
        w, o, f = np.concatenate(words), np.concatenate(owner), np.concatenate(first)
        order = np.lexsort((o, f, w))
        w, o, f = w[order], o[order], f[order]
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        lead = np.repeat(head, np.diff(np.append(head, len(w))))
        ok = ~f[lead] & (o != o[lead])
        a, b = forest(np.concatenate([a, fps[o[ok]]]), np.concatenate([b, fps[o[lead[ok]]]]))
    return a, b


def link_sorted(group: np.ndarray, fps: np.ndarray, radius: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by group: neighbours at growing distance for small groups, `link_group` for large ones."""
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    sizes = np.diff(np.append(head, len(group)))
    per_row = np.repeat(sizes, sizes)
    a, b = [fps[:0]], [fps[:0]]
    at = np.flatnonzero((per_row > 1) & (per_row <= small))
    last = np.repeat(head + sizes, sizes)
    for d in range(1, small):
        at = at[at + d < last[at]]
        if not len(at):
            break
        hit = at[near(fps[at], fps[at + d], radius) & (fps[at] != fps[at + d])]
        a.append(fps[hit])
        b.append(fps[hit + d])
    for k in np.flatnonzero(sizes > small):
        x, y = link_group(np.unique(fps[head[k] : head[k] + sizes[k]]), radius)
        a.append(x)
        b.append(y)
    return forest(np.concatenate(a), np.concatenate(b))


def spread_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints of one table within the radius connect, dealt by words over tasks.

    As `link_dense`: each fingerprint goes to all words at most radius - radius // 2 bits away, and all that meet at a
    word are linked to the least of those at most radius // 2 bits from it. A task thins its links to a forest.
    """
    low, high = radius // 2, radius - radius // 2
    turns = [(k > low, signed(sum(1 << b for b in c))) for k in range(high + 1) for c in combinations(range(BITS), k)]
    masks = F.array(*[F.struct(F.lit(far).alias("far"), F.lit(mask).alias("mask")) for far, mask in turns])
    met = fps.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m.mask")).alias("word"), F.col("m.far").alias("far"), "fp").repartition("word")
    lead = met.groupBy("word").agg(F.min(F.struct("far", "fp")).alias("lead")).where("NOT lead.far").select("word", F.col("lead.fp").alias("b"))

    def thin(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in source:
            x, y = (np.asarray(c).astype(np.int64) for c in batch.columns)
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return met.join(lead, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").mapInArrow(thin, "a long, b long")


def links(fps: DataFrame, radius: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints within the radius connect.

    Buckets are searched in one task each; those of more than `crowd` fingerprints by `spread_links`, in many.
    """
    plan = plan_search(fps, radius)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = link_sorted(group, fps, radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        rest_g, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in source:
            if not batch.num_rows:
                continue
            part, key = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)
            fps = np.asarray(batch.column(2)).astype(np.int64).view(np.uint64)
            # One number per bucket: partitions have bits of their own, so a multiple of the partition tells them apart.
            group = (key.view(np.uint64) ^ (part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
            rest_g, rest_f = np.concatenate([rest_g, group]), np.concatenate([rest_f, fps])
            cut = int(np.flatnonzero(rest_g != rest_g[-1])[-1]) + 1 if (rest_g != rest_g[-1]).any() else 0
            if cut >= 200_000:
                yield emit(rest_g[:cut], rest_f[:cut])
                rest_g, rest_f = rest_g[cut:], rest_f[cut:]
        if len(rest_g):
            yield emit(rest_g, rest_f)

    rows = probes(fps, plan)
    # A crowded bucket holds more than `crowd` of all probes, so there are few of them beside the fingerprints.
    crowded = materialize(rows.groupBy("part", "key").count().where(F.col("count") > crowd).select("part", "key"), "crowded-buckets")
    if crowded.isEmpty():
        return rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "a long, b long")
    dense = materialize(rows.join(F.broadcast(crowded), ["part", "key"], "left_semi").select("fp").distinct(), "crowded-fingerprints")
    rows = rows.join(F.broadcast(crowded), ["part", "key"], "left_anti")
    return rows.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "a long, b long").union(spread_links(dense, radius))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of documents; component_id: the least doc_id that links reach.

    Texts without words share fingerprint 0 and link like others. A null doc_id takes part and is never the least;
    a component of null ids only has a null component_id. Repeated rows come back as often as they stand.
    """
    fps = materialize(fingerprints(docs, width=width), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(links(distinct, radius))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    joined = joined.select("fp", "first_id", "root")
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(named, fps["fp"] == named["__fp"]).select("doc_id", "fp", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets --------------------------------------------------------------------------------------


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of a text, sorted, each once. Fewer words: the whole sequence; none: no hash."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = max(1, len(words) - width + 1)
    ends = starts[min(width, len(words)) :][:n] - 1
    return np.unique(span_hash(prefix_hash(np.frombuffer(b" ".join(words), np.uint8)), starts[:n], ends))


def size_bounds(similarity: float) -> list[int]:
    """Least sizes of ranges such that sets of that similarity lie in the same range or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, ceil(out[-1] / similarity)))
    return out


def most_differences(sizes: int, similarity: float) -> int:
    """How many hashes two sets of that similarity have on one side only, at most; sizes: of both together."""
    return floor(sizes * (1 - similarity) / (1 + similarity) + 1e-9)


def search_keys(h: np.ndarray, similarity: float, bounds: list[int], parts: int | None) -> list[int]:
    """Keys by which sets of at least that similarity meet.

    For its own range of sizes and the next, the hashes are dealt over one part more than two such sets can differ in.
    By the pigeonhole principle some part is the same in both; its key is the SimHash of the part. The same part can
    be an empty one, so sets with an empty part have a key for each of their least hashes as well, as many as make one
    of them common to both. With `parts` at most so many parts are used: of m parts and fewer than m differences each
    is the same with a chance of 0.37 or more, so that all of 24 differ once in 60,000 cases at the limit and more
    rarely above it. None: all parts, nothing is missed.
    """
    n, keys = len(h), []
    if not n:
        return []
    at = bisect_right(bounds, n) - 1
    for label in (at, at + 1):
        m = most_differences(2 * (bounds[label + 1] - 1), similarity) + 1
        part = mix64(h + np.uint64(label + 1)) % np.uint64(m)
        mine = np.flatnonzero(part < min(m, parts or m))
        mine = mine[np.argsort(part[mine], kind="stable")]
        if len(mine):
            head = np.flatnonzero(np.append(True, np.diff(part[mine]) != 0))
            size = np.diff(np.append(head, len(mine)))
            bits = np.unpackbits(h[mine].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, head, axis=0, dtype=np.int64)
            fp = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            keys.append(mix64(fp ^ mix64(part[mine][head] + np.uint64((label + 1) << 32))))
        if m <= (parts or m) and (not len(mine) or len(head) < m):
            least = h[: n - ceil(similarity * n - 1e-9) + 1]
            keys.append(mix64(least ^ mix64(np.uint64([label + 1]))))
    return np.unique(np.concatenate(keys)).view(np.int64).tolist()


def parity_bits(h: np.ndarray) -> np.ndarray:
    """Words of a bit array of at least two bits a hash, a bit being set if an odd number of hashes fall on it.

    Two of them differ in no more bits than their sets differ in hashes. Half as many bits: `fold`.
    """
    width = max(BITS, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def shingle_signatures(docs: DataFrame, similarity: float, width: int, parts: int | None) -> DataFrame:
    """(doc_id, th, c1, c2, n, fp, keys): th tells texts under one id apart; c1 and c2, 128 bits, name the shingle set."""
    bounds = size_bounds(similarity)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            names, size, fps, keys = [], [], [], []
            for t in batch.column(2).cast(pa.large_binary()).to_pylist():
                h = shingle_set(t, width)
                names.append([mix64(h ^ np.uint64(s)).sum(dtype=np.uint64) + np.uint64(len(h)) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)])
                size.append(len(h))
                fps.append(fingerprint(t))
                keys.append(search_keys(h, similarity, bounds, parts))
            c = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(size, pa.int64()), fp, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "c1", "c2", "n", "fp", "keys"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, th long, c1 long, c2 long, n long, fp long, keys array<long>")


def fingerprint_pairs(classes: DataFrame, radius: int = 3, files: int | None = None) -> DataFrame:
    """Pairs (a, b) of classes that the search over fingerprints gives: one for each class but a component's least."""
    prints = materialize(classes.where("n > 0").groupBy("fp").agg(F.min("cls").alias("first")), "class-fingerprints", files)
    same = classes.join(prints, "fp").where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b"))
    x, y = prints.toDF("a", "x"), prints.toDF("b", "y")
    near = links(prints, radius).join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(near)


def head_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each class with the least one that it shares a key with."""
    heads = members.groupBy("key").agg(F.min("cls").alias("head"))
    return members.join(heads, "key").groupBy("cls").agg(F.min("head").alias("a")).where("a <> cls").select("a", F.col("cls").alias("b"))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, broadcast_rows: int = 500_000) -> DataFrame:
    """(cls, shingles, bits) of the classes named, made again from the whole text of each one's first document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text"):
            sets = [shingle_set(t, width) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            bits = [parity_bits(h).tobytes() for h in sets]
            yield pa.record_batch([batch.column(0), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["cls", "shingles", "bits"])

    wanted = wanted.select("cls", F.col("rep.doc_id").alias("__id"), F.col("rep.th").alias("__th"))
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["__id"]) & (texts["th"] == wanted["__th"])).select("cls", "text")
    return texts.mapInArrow(run, "cls long, shingles array<long>, bits binary").dropDuplicates(["cls"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are similar."""
    whole = sets.select("cls", "shingles")
    both = pairs.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * F.lit(1 + similarity) >= (F.size("sa") + F.size("sb")) * F.lit(similarity) - 1e-9).select("a", "b")


def compare_groups(home: tuple, visitors: tuple, similarity: float, best: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a home and a visiting class of different components that can be similar by sizes and parity bits.

    For each visitor and each component at home the `best` nearest ones; then the visitors for whom others were left.
    None: the nearest one of all for each visitor, and no visitors.
    """
    cls, comp, n, bits = home
    vcls, vcomp, vn, vbits = visitors
    words = min(min(map(len, bits)), min(map(len, vbits))) // 8
    x, y = (np.stack([fold(np.frombuffer(b, np.uint64), words) for b in some]) for some in (bits, vbits))
    step, left, right, far = max(1, (1 << 20) // (len(cls) * words)), [], [], []
    for at in range(0, len(vcls), step):
        d = np.bitwise_count(y[at : at + step, None] ^ x[None]).sum(axis=2, dtype=np.int64)
        a, b = vn[at : at + step, None], n[None]
        ok = (d * (1 + similarity) <= (a + b) * (1 - similarity) + 1e-6) & (np.minimum(a, b) >= np.maximum(a, b) * similarity - 1e-9) & (vcomp[at : at + step, None] != comp[None])
        v, h = np.nonzero(ok)
        left.append(v + at)
        right.append(h)
        far.append(d[v, h])
    v, h, d = map(np.concatenate, (left, right, far))
    group = comp[h] if best else np.zeros(len(h), np.int64)
    order = np.lexsort((cls[h], d, group, v))
    v, h, group = v[order], h[order], group[order]
    new = np.append(True, (v[1:] != v[:-1]) | (group[1:] != group[:-1])) if len(v) else np.zeros(0, bool)
    rank = np.arange(len(v)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(v))))
    keep = rank < (best or 1)
    return cls[h[keep]], vcls[v[keep]], np.unique(vcls[v[~keep]]) if best else vcls[:0]


def open_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame, asked: DataFrame | None, similarity: float, best: int | None, room: int = 512) -> DataFrame:
    """(a, b): pairs of classes that share a key, lie in different components and can be similar; and (a, null) for
    each class of which pairs beyond the `best` of a component were left out (`compare_groups`).

    Keys whose classes are all in one component are done. Of the others the classes outside a key's largest component
    visit all classes of the key; `asked` (cls) names those that do, None: all. Both sides are dealt over blocks of
    about `room` classes, so a key of any size is worked on in many tasks of bounded size.
    """
    named = members.join(roots.toDF("node", "root"), F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("root", "cls").alias("comp"))
    if asked is None:
        named = named.withColumn("asks", F.lit(True))
    else:
        named = named.join(asked.withColumn("asks", F.lit(True)), "cls", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    named = materialize(named, "members-of-components", files_for(members.count())).repartition("key")
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("asks").cast("long")).alias("a"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.sum("a").alias("a"), F.max(F.struct("c", "comp", "a")).alias("most"), F.count(F.lit(1)).alias("comps"))
    sizes = sizes.where("comps > 1 AND a > most.a").select("key", F.col("most.comp").alias("main"), F.ceil(F.col("c") / room).cast("int").alias("i"), F.ceil((F.col("a") - F.col("most.a")) / room).cast("int").alias("j"))
    rows = named.join(sizes, "key").join(sets.select("cls", F.size("shingles").alias("n"), "bits"), "cls")
    deal = lambda k: F.pmod(F.xxhash64("cls", "key"), F.col(k)).cast("int")
    all_of = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    kept = ["cls", "comp", "n", "bits"]
    home = rows.select("key", deal("i").alias("i"), F.explode(all_of("j")).alias("j"), F.lit(True).alias("home"), *kept)
    away = rows.where("asks AND comp <> main").select("key", F.explode(all_of("i")).alias("i"), deal("j").alias("j"), F.lit(False).alias("home"), *kept)

    def groups(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches cut where a group ends, so that none is split; one holds what was read last and little more."""
        rest: pa.Table | None = None
        for batch in source:
            now = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            name = np.stack([np.asarray(now.column(c)).astype(np.int64) for c in ("key", "i", "j")], axis=1)
            cut = np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1
            if len(cut):
                yield now.slice(0, int(cut[-1]))
            rest = now.slice(int(cut[-1])) if len(cut) else now
        if rest is not None and rest.num_rows:
            yield rest

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(source):
            name = np.stack([np.asarray(table.column(c)).astype(np.int64) for c in ("key", "i", "j")], axis=1)
            at_home = np.asarray(table.column("home")).astype(bool)
            cls, comp, n = (np.asarray(table.column(c)).astype(np.int64) for c in ("cls", "comp", "n"))
            bits = table.column("bits").to_pylist()
            ends = np.append(np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1, len(name))
            a, b, more = [cls[:0]], [cls[:0]], [cls[:0]]
            start = 0
            for end in ends.tolist():
                h, v = (start + np.flatnonzero(at_home[start:end] == side) for side in (True, False))
                start = end
                if len(h) and len(v):
                    x, y, left = compare_groups(*[(cls[s], comp[s], n[s], [bits[k] for k in s]) for s in (h, v)], similarity, best)
                    a.append(x)
                    b.append(y)
                    more.append(left)
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            left = np.unique(np.concatenate(more))
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            yield pa.record_batch([pa.array(left), pa.nulls(len(left), pa.int64())], ["a", "b"])

    dealt = home.unionByName(away).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, parts: int | None = PARTS) -> DataFrame:
    """(root, rep, classes): a row for each group of documents that similarity links, over any number of steps.

    Documents with one shingle set are a class. The search over fingerprints and one head for each class give pairs
    that unite part of what belongs together. Then classes that share a key and aren't in one group yet are compared,
    all of them: first each is verified with the nearest one, then with the nearest of each group, then with ever more
    of them until none is left that could be similar. Pairs are verified on whole sets. rep.doc_id and rep.th name a group's first document: the least doc_id, null after all
    others, then the least hash of the text. Texts without words form a group of their own; repeated rows are in one
    group. An empty table has no groups.
    """
    signatures = shingle_signatures(docs, similarity, width, parts)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    classes = signatures.groupBy("c1", "c2").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = materialize(classes.drop("c1", "c2").withColumn("cls", F.monotonically_increasing_id()), "shingle-classes")
    # Keys are some fifty a class, everything else narrow is about one row a class.
    few, many = (files_for(k * classes.count()) for k in (1, 50))
    keyed = classes.select(F.explode("keys").alias("key"), "cls").repartition("key")
    members = materialize(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "key", "left_semi"), "members", many)
    pairs = materialize(fingerprint_pairs(classes, files=few).union(head_pairs(members)).distinct(), "candidate-pairs", few)
    named = members.select("cls").union(pairs.select(F.explode(F.array("a", "b")))).distinct()
    sets = materialize(sets_of(docs, classes.join(named, "cls", "left_semi"), width), "shingle-sets")
    edges = materialize(verified(pairs, sets, similarity), "similar-pairs", few)
    roots, best, asked = connected_components(edges, files=few), None, None
    while True:
        found = materialize(open_pairs(members, roots, sets, asked, similarity, best), "open-pairs", few)
        some = found.where("b IS NOT NULL")
        linked = materialize(verified(some.join(pairs, ["a", "b"], "left_anti"), sets, similarity), "similar-pairs", few)
        if not linked.isEmpty():
            edges = edges.union(linked)
            roots = connected_components(edges, files=few)
        if best:
            asked = found.where("b IS NULL").select(F.col("a").alias("cls"))
            if asked.isEmpty():
                break
        pairs, best = pairs.union(some), best * 64 if best else 1
    joined = classes.join(roots, classes["cls"] == roots["node"], "left").withColumn("root", F.coalesce("root", "cls"))
    return joined.groupBy("root").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("classes"))


def keep_one(docs: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """Documents with one of each group left whose five-word shingles are similar by 0.8 or more: see `similar_groups`."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\0null"))
    keep = similar_groups(docs.select("doc_id", "text"), parts=parts).select(name(F.col("rep.doc_id")).alias("__id"), F.col("rep.th").alias("__th"))
    keep = materialize(keep, "kept-ids")
    marked = docs.withColumn("__id", name(F.col("doc_id"))).withColumn("__th", F.xxhash64("text"))
    return marked.join(keep, ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"]).drop("__id", "__th")
