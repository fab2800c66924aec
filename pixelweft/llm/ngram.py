"""Language-model scoring with an n-gram trie whose levels are Elias-Fano sequences in mapped files.

A level is one increasing sequence cut into segments; a segment is a file that one task writes and every worker maps.

* Level 1: 64-bit hashes of the words; a word's id is its place. Running token counts give exact counts.
* Level 2: first id * V + second id, of the pairs seen at least `keep` times.
* Level 3: (place of the first pair) * S + (place of the third word among the successors of the second).

The last number is the word relative to its context: the successors of one word are few against V, so it needs few
bits, and the place of a pair minus the pointer of its first word yields it. Pointers (for each entry, where its
successors begin one level below) never fall and are Elias-Fano sequences too. A lookup is one successor search.

Smoothing: interpolated absolute discounting, down to the add-one base over known words and one unknown word. The
mass that discounts and dropped n-grams leave goes to the shorter context, so probabilities of a context sum to one
before quantisation. Probabilities and back-off weights are stored as one byte between a segment's extremes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, reuse_freed, scratch_path
from .eliasfano import EliasFano, pack, unpack

#: The hash of the end of a text, and by how much counts are discounted.
END, DISCOUNT = np.uint64(0x9D39247E33776D41), 0.75
#: Low bits that keys are short of: room for time.
SPARE = 2
#: Entries of a segment that are worked on at a time.
ROOM = 1 << 19


# --- files -----------------------------------------------------------------------------------------------------------


def write_file(uri: str, raw: bytes) -> None:
    """Whole or not at all: a retried or doubled task replaces the file by the same bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    own = f"{path}.{np.random.default_rng().integers(1 << 62):x}.part"
    with fs.open_output_stream(own) as f:
        f.write(raw)
    fs.move(own, path)


_OPEN: dict[str, list[np.ndarray]] = {}


def map_file(uri: str) -> list[np.ndarray]:
    """A file's arrays, mapped. A store that isn't a local folder is copied once per worker to an unnamed file."""
    if uri not in _OPEN:
        if len(_OPEN) > 20_000:
            _OPEN.clear()
        fs, path = pafs.FileSystem.from_uri(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            raw = np.asarray(np.memmap(path, np.uint8, "r"))
        else:
            with tempfile.TemporaryFile() as own, fs.open_input_stream(path) as f:
                while piece := f.read(1 << 24):
                    own.write(piece)
                own.flush()
                raw = np.asarray(np.memmap(own, np.uint8, "r"))
        _OPEN[uri] = unpack(raw)
    return _OPEN[uri]


@dataclass
class Level:
    """Segments of one level: the first key, the first place and the count before each."""

    root: str
    name: str
    first: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    files: list[int] = field(default_factory=list)
    n: int = 0
    total: int = 0

    def uri(self, part: int, kind: str) -> str:
        return f"{self.root}/{self.name}-{part:06d}.{kind}"

    def sequence(self, s: int, kind: str, at: int) -> EliasFano:
        """The sequence of segment s that begins at array `at` of a file."""
        return EliasFano.of(map_file(self.uri(self.files[s], kind))[at : at + EliasFano.PARTS])

    def _by_key(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.first, np.uint64), keys, "right") - 1

    def _each(self, seg: np.ndarray, n_out: int, f: Callable, args: tuple, kinds: tuple) -> list[np.ndarray]:
        """Runs f(segment, rows of args) for the segments named, and puts the results together."""
        out = [np.zeros(len(seg), kinds[k]) for k in range(n_out)]
        if not len(seg):
            return out
        # Rows in the order of their segments, as sorted keys are, are passed on as slices.
        order = None if (seg[1:] >= seg[:-1]).all() else np.argsort(seg, kind="stable")
        cuts = np.searchsorted(seg if order is None else seg[order], np.arange(len(self.files) + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            rows = slice(cuts[s], cuts[s + 1]) if order is None else order[cuts[s] : cuts[s + 1]]
            got = f(s, *[a[rows] for a in args])
            for k in range(n_out):
                out[k][rows] = got[k]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the least key >= each, and whether it is equal."""
        seg = np.maximum(self._by_key(keys), 0) if self.files else np.zeros(0, int)
        if not self.files:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)

        def one(s: int, k: np.ndarray) -> tuple:
            at, same = self.sequence(s, "keys", 0).successor(k)
            return at + self.place[s], same

        at, same = self._each(seg, 2, one, (keys,), (np.int64, bool))
        return at, same

    def _local(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.place, np.int64), places, "right") - 1

    def keys(self, places: np.ndarray) -> np.ndarray:
        return self._each(self._local(places), 1, lambda s, p: (self.sequence(s, "keys", 0).access(p - self.place[s]),), (places,), (np.uint64,))[0]

    def before(self, places: np.ndarray) -> np.ndarray:
        """Sum of the counts before each place; n names the end."""
        out = np.full(len(places), self.total, np.int64)
        ok = np.flatnonzero(places < self.n)
        p = places[ok]
        out[ok] = self._each(self._local(p), 1, lambda s, q: (self.sequence(s, "keys", EliasFano.PARTS).access(q - self.place[s]).astype(np.int64) + self.count[s],), (p,), (np.int64,))[0]
        return out

    def _spans(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(segment, first, end) of the places from a to b - 1, counted in their segment."""
        s = max(0, int(np.searchsorted(self.place, a, "right")) - 1)
        while s < len(self.files) and self.place[s] < b:
            end = self.place[s + 1] if s + 1 < len(self.files) else self.n
            yield s, max(a, self.place[s]) - self.place[s], min(b, end) - self.place[s]
            s += 1

    def keys_span(self, a: int, b: int) -> np.ndarray:
        """The keys at the places from a to b - 1."""
        return np.concatenate([np.zeros(0, np.uint64), *[self.sequence(s, "keys", 0).span(x, y) for s, x, y in self._spans(a, b)]])

    def counts_span(self, a: int, b: int) -> np.ndarray:
        """The counts at the places from a to b - 1; a segment holds one sum more than it has places."""
        return np.concatenate([np.zeros(0, np.int64), *[np.diff(self.sequence(s, "keys", EliasFano.PARTS).span(x, y + 1).astype(np.int64)) for s, x, y in self._spans(a, b)]])

    def counts(self, places: np.ndarray) -> np.ndarray:
        return self.before(places + 1) - self.before(places)

    def pointer(self, places: np.ndarray) -> np.ndarray:
        return self._each(self._local(places), 1, lambda s, p: (self.sequence(s, "down", 2).access(p - self.place[s]).astype(np.int64) + int(map_file(self.uri(self.files[s], "down"))[-1][0]),), (places,), (np.int64,))[0]

    def _coded(self, places: np.ndarray, kind: str) -> np.ndarray:
        def one(s: int, p: np.ndarray) -> tuple:
            scale, codes = map_file(self.uri(self.files[s], kind))[:2]
            return (scale[0] + codes[p - self.place[s]] * scale[1],)

        return self._each(self._local(places), 1, one, (places,), (np.float64,))[0]

    def backoff(self, places: np.ndarray) -> np.ndarray:
        return self._coded(places, "down")

    def prob(self, places: np.ndarray) -> np.ndarray:
        return self._coded(places, "prob")


def quantise(x: np.ndarray) -> list[np.ndarray]:
    lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (hi - lo) / 255 or 1.0
    return [np.array([lo, step]), np.rint((x - lo) / step).astype(np.uint8)]


# --- tokens ----------------------------------------------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token and the text that it is of: the words of a text in order, then its end."""
    w = Words(texts)
    n = len(texts)
    h = np.full(len(w.text) + n, END, np.uint64)
    h[np.arange(len(w.text)) + w.text] = w.hashes()
    text = np.repeat(np.arange(n), w.count + 1)
    return h, text


@dataclass
class Trie:
    """The model as tasks receive it: folders and the few numbers of each segment."""

    levels: list[Level] = field(default_factory=list)
    order: int = 3
    span: int = 1

    @property
    def vocabulary(self) -> int:
        return self.levels[0].n

    @property
    def tokens(self) -> int:
        return self.levels[0].total

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct words (-1: unknown), which of them are known, and the word that each token is."""
        words, back = np.unique(h, return_inverse=True)
        at, same = self.levels[0].find(words)
        return np.where(same, at, -1), same, back

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Add-one probability, in log10."""
        return np.log10((counts + 1.0) / (self.tokens + 1.0 * (self.vocabulary + 1)))

    def pair_keys(self, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs that end at each token, and which tokens have a pair of known words."""
        ok = np.zeros(len(ids), bool)
        ok[1:] = (text[1:] == text[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
        key = np.zeros(len(ids), np.uint64)
        at = np.flatnonzero(ok)
        key[at] = ids[at - 1].astype(np.uint64) * np.uint64(self.vocabulary) + ids[at].astype(np.uint64)
        return key, ok

    def pairs(self, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the distinct pairs of known words (-1: none), the tokens that end one, and which one each of them is."""
        key, ok = self.pair_keys(ids, text)
        keys, back = np.unique(key[ok], return_inverse=True)
        at, same = self.levels[1].find(keys)
        return np.where(same, at, -1), np.flatnonzero(ok), back

    def pointers(self, ids: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Where the pairs begin that distinct words are the first of; 0 for unknown ones."""
        out = np.zeros(len(ids), np.int64)
        out[same] = self.levels[0].pointer(ids[same])
        return out

    def triple_keys(self, pairs: np.ndarray, pointers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that end a triple of two pairs, and its key: context, and word relative to its context.

        pairs: the place of the pair that each token ends; pointers: of the pairs that begin with each token.
        """
        ok = np.zeros(len(pairs), bool)
        ok[2:] = (text[2:] == text[:-2]) & (pairs[2:] >= 0) & (pairs[1:-1] >= 0)
        at = np.flatnonzero(ok)
        relative = pairs[at] - pointers[at - 1]
        return at, pairs[at - 1].astype(np.uint64) * np.uint64(self.span) + relative.astype(np.uint64)

    def score(self, h: np.ndarray, text: np.ndarray, n: int) -> dict[str, np.ndarray]:
        words, same, back = self.words(h)
        ids = words[back]
        counts = np.zeros(len(words), np.int64)
        counts[same] = self.levels[0].counts(words[same])
        base = self.base(counts)[back]
        p = base.copy()
        if self.order > 1 and self.levels[1].n:
            rest = np.zeros(len(words))
            rest[same] = self.levels[0].backoff(words[same])
            rest = rest[back]
            later = np.zeros(len(ids), bool)
            later[1:] = text[1:] == text[:-1]
            t = np.flatnonzero(later)
            p[t] += rest[t - 1]
            places, ends, which = self.pairs(ids, text)
            seen = np.flatnonzero(places >= 0)
            own, off = np.zeros(len(places)), np.zeros(len(places))
            own[seen] = self.levels[1].prob(places[seen])
            hit = (places >= 0)[which]
            p[ends[hit]] = own[which[hit]]
            if self.order > 2 and self.levels[2].n:
                off[seen] = self.levels[1].backoff(places[seen])
                pairs, rest2 = np.full(len(ids), -1, np.int64), np.zeros(len(ids))
                pairs[ends], rest2[ends] = places[which], off[which]
                p[t] += rest2[t - 1]
                at, key = self.triple_keys(pairs, self.pointers(words, same)[back], text)
                keys, which = np.unique(key, return_inverse=True)
                place, found = self.levels[2].find(keys)
                value = np.zeros(len(keys))
                value[found] = self.levels[2].prob(place[found])
                ok = found[which]
                p[at[ok]] = value[which[ok]]
        total = np.bincount(text, minlength=n)
        return {"n_tokens": total, "n_known": np.bincount(text, ids >= 0, n).astype(np.int64), "base_score": np.bincount(text, base, n), "score": np.bincount(text, p, n)}


# --- training --------------------------------------------------------------------------------------------------------


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    return k[head], (np.add.reduceat(c, head) if len(k) else c)


def _count_level(docs: DataFrame, level: Level, keys_of: Callable, part_of: Callable, parts: int, keep: int) -> Level:
    """Counts keys over all rows and writes a level's segments.

    A task adds up its own keys first and sends each of `parts` ranges as sorted bytes; a range is put together in one
    task. Keys that stand once are sent without a count.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed()
        held: tuple[list, list] = ([], [])
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held[0]:
                return
            k, c = _merge(*held)
            held[0].clear()
            held[1].clear()
            p = part_of(k)
            cuts = np.searchsorted(p, np.arange(parts + 1))
            out = []
            for q in np.flatnonzero(np.diff(cuts)):
                kk, cc = k[cuts[q] : cuts[q + 1]], c[cuts[q] : cuts[q + 1]]
                one = cc == 1
                out.append((int(q), kk[one].tobytes(), kk[~one].tobytes(), cc[~one].tobytes()))
            for at in range(0, len(out), 64):
                cols = list(zip(*out[at : at + 64], strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["part", "once", "keys", "counts"])

        for batch in batches(source, "text", 4_000_000):
            k = keys_of(*tokens(batch.column(0)))
            k, c = np.unique(k, return_counts=True)
            held[0].append(k)
            held[1].append(c.astype(np.int64))
            rows += len(k)
            if rows > 6_000_000:
                yield from flush()
                rows = 0
        yield from flush()

    def gather(table: pa.Table) -> pa.Table:
        once, many, counts = ([np.frombuffer(x.as_buffer(), kind) for x in table[name]] for name, kind in (("once", np.uint64), ("keys", np.uint64), ("counts", np.int64)))
        # Most keys stand once: they are sorted in place, and the others put in between.
        k = np.concatenate(once)
        k.sort()
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
        c = np.diff(np.append(head, len(k)))
        k = k[head]
        del head
        more, times = _merge(many, counts)
        at = np.searchsorted(k, more)
        same = np.append(k, more[:1])[at] == more if len(more) else np.zeros(0, bool)
        same &= at < len(k)
        c[at[same]] += times[same]
        k, c = np.insert(k, at[~same], more[~same]), np.insert(c, at[~same], times[~same])
        if keep > 1:
            k, c = k[c >= keep], c[c >= keep]
        part = table["part"][0].as_py()
        if len(k):
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(c)])
            write_file(level.uri(part, "keys"), pack(EliasFano.encode(k, SPARE) + EliasFano.encode(sums.astype(np.uint64))))
        first = str(int(k[0])) if len(k) else ""
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(k)], "total": [int(c.sum())], "first": [first]})

    blobs = docs.select("text").mapInArrow(run, "part int, once binary, keys binary, counts binary")
    rows = sorted(r for r in blobs.groupBy("part").applyInArrow(gather, "part int, n long, total long, first string").collect() if r.n)
    for r in rows:
        level.files.append(r.part)
        level.first.append(int(r.first))
        level.place.append(level.n)
        level.count.append(level.total)
        level.n += r.n
        level.total += r.total
    return level


def _over_segments(spark: SparkSession, level: Level, f: Callable[[int, int, int], int]) -> int:
    """Runs f(segment, first place, places) for every segment of a level, one task each; the largest result."""
    if not level.files:
        return 0
    spans = list(zip(range(len(level.files)), level.place, [*level.place[1:], level.n], strict=True))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for s, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield pa.record_batch([pa.array([f(s, a, b - a)], pa.int64())], ["top"])

    jobs = spark.createDataFrame(spans, "s int, a long, b long").repartitionByRange(min(len(spans), 512), "s")
    return jobs.mapInArrow(run, "top long").agg(F.max("top")).first()[0]


def _finish(spark: SparkSession, trie: Trie, upper: int) -> int:
    """Pointers from level `upper` down to the next and its back-off weights; the most successors of an entry."""
    up, down = trie.levels[upper], trie.levels[upper + 1]
    width = trie.vocabulary if upper == 0 else trie.span

    def one(s: int, a: int, n: int) -> int:
        at, rest, many = np.empty(n + 1, np.int64), np.empty(n), np.zeros(n, np.int64)
        at[[0, n]], _ = down.find(np.array([a, a + n], np.uint64) * np.uint64(width))
        if a + n == up.n:
            at[n] = down.n
        seen = np.zeros(n, np.int64)
        # The entries below are read in a row; those of a context that two reads share are added up.
        for lo in range(int(at[0]), int(at[n]), ROOM):
            hi = min(lo + ROOM, int(at[n]))
            own = (down.keys_span(lo, hi) // np.uint64(width)).astype(np.int64) - a
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            many[own[head]] += np.diff(np.append(head, len(own)))
            seen[own[head]] += np.add.reduceat(down.counts_span(lo, hi), head)
        np.cumsum(many, out=at[1:])
        at[1:] += at[0]
        for lo in range(0, n, ROOM):
            hi = min(lo + ROOM, n)
            rest[lo:hi] = 1.0 - (seen[lo:hi] - DISCOUNT * many[lo:hi]) / np.maximum(up.counts_span(a + lo, a + hi), 1)
        ptr = EliasFano.encode((at - at[0]).astype(np.uint64))
        write_file(up.uri(up.files[s], "down"), pack([*quantise(np.log10(np.maximum(rest, 1e-9))), *ptr, np.array([at[0]], np.int64)]))
        return int(many.max()) if n else 0

    return _over_segments(spark, up, one)


def _probabilities(spark: SparkSession, trie: Trie, at: int) -> None:
    """Smoothed probabilities of the entries of level 2 or 3."""
    level, up = trie.levels[at], trie.levels[at - 1]
    words = trie.levels[0]

    def some(lo: int, hi: int) -> np.ndarray:
        keys, counts = level.keys_span(lo, hi), level.counts_span(lo, hi)
        width = np.uint64(trie.vocabulary if at == 1 else trie.span)
        context, own = (keys // width).astype(np.int64), (keys % width).astype(np.int64)
        new = np.append(True, context[1:] != context[:-1])
        heads, back = context[new], np.cumsum(new) - 1
        rest, weight = up.backoff(heads)[back], up.counts(heads)[back]
        if at == 1:
            last, where = np.unique(own, return_inverse=True)
            lower = trie.base(words.counts(last))[where]
        else:
            second = (up.keys(heads) % np.uint64(trie.vocabulary)).astype(np.int64)
            lower = up.prob(words.pointer(second)[back] + own)
        p = (counts - DISCOUNT) / weight + 10.0 ** (rest + lower)
        return np.log10(np.minimum(p, 1.0))

    def one(s: int, a: int, n: int) -> int:
        p = np.empty(n)
        for lo in range(0, n, ROOM):
            p[lo : lo + ROOM] = some(a + lo, a + min(lo + ROOM, n))
        write_file(level.uri(level.files[s], "prob"), pack(quantise(p)))
        return 0

    _over_segments(spark, level, one)


def train(docs: DataFrame, order: int = 3, keep: int = 1, parts: int | None = None) -> Trie:
    """Learns from the column text of all rows of `docs` (null: empty).

    Files go to the folder that driver and executors share. `keep`: n-grams of two and three words seen less often
    are dropped from the trie (single words never are); what they held backs off. 1 drops none. No rows: every word is unknown.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "trie")
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    trie = Trie(order=order)
    shift = np.float64(parts / 2.0**64)
    trie.levels.append(_count_level(docs, Level(root, "one"), lambda h, t: h, lambda k: np.minimum((k.astype(np.float64) * shift).astype(np.int64), parts - 1), parts, 1))
    if order > 1:
        words = trie.levels[0]
        parts = max(parts, trie.tokens // 4_000_000)

        def mass(k: np.ndarray) -> np.ndarray:
            """Where a pair stands in the running token count: equal shares, and a frequent first word is split."""
            first, second = (k // np.uint64(trie.vocabulary)).astype(np.int64), (k % np.uint64(trie.vocabulary)).astype(np.float64)
            heads, back = np.unique(first, return_inverse=True)
            start = words.before(heads)
            size = words.before(heads + 1) - start
            return np.minimum(((start[back] + size[back] * (second / trie.vocabulary)) * (parts / max(1, trie.tokens))).astype(np.int64), parts - 1)

        def pair(h: np.ndarray, t: np.ndarray) -> np.ndarray:
            words, _, back = trie.words(h)
            key, ok = trie.pair_keys(words[back], t)
            return key[ok]

        trie.levels.append(_count_level(docs, Level(root, "two"), pair, mass, parts, keep))
        trie.span = _finish(spark, trie, 0) + 1
        _probabilities(spark, trie, 1)
    if order > 2:
        if trie.levels[1].n * trie.span >= 1 << 64:
            raise OverflowError("keys of the third level exceed 64 bits")
        pairs = max(1, trie.levels[1].n)

        def triple(h: np.ndarray, t: np.ndarray) -> np.ndarray:
            words, same, back = trie.words(h)
            places, ends, which = trie.pairs(words[back], t)
            pairs = np.full(len(h), -1, np.int64)
            pairs[ends] = places[which]
            return trie.triple_keys(pairs, trie.pointers(words, same)[back], t)[1]

        wide = float(pairs) * trie.span
        trie.levels.append(_count_level(docs, Level(root, "three"), triple, lambda k: np.minimum((k.astype(np.float64) * (parts / wide)).astype(np.int64), parts - 1), parts, keep))
        _finish(spark, trie, 1)
        _probabilities(spark, trie, 2)
    return trie


def score(docs: DataFrame, trie: Trie, columns: list[str]) -> DataFrame:
    """The columns named, and n_tokens, n_known, base_score and score of each row's text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed()
        for batch in batches(source, "__text", 4_000_000):
            h, text = tokens(batch.column(batch.num_columns - 1))
            got = trie.score(h, text, batch.num_rows)
            out = [pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"], pa.int64()), pa.array(got["base_score"]), pa.array(got["score"])]
            yield pa.record_batch([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, f"{kept}, n_tokens long, n_known long, base_score double, score double")


def held_out(key: str = "doc_id") -> F.Column:
    """Rows whose CRC-32 of the key as text leaves 2 when divided by 7; a null key counts as no bytes."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_report(docs: DataFrame, order: int = 3, keep: int = 1) -> DataFrame:
    """Scores all documents with a model learnt from those not held out: (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score).

    Null and empty texts have one token, their end. Repeated rows and ids, null ones too, are scored as often as they
    stand, and learnt from as often. Texts of any length are scored whole. Other columns are left out. With no rows to
    learn from every word is unknown; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out())
    trie = train(docs.where(~F.col("held_out")), order, keep)
    out = score(docs, trie, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")
