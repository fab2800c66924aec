"""Exact substring deduplication by a distributed sort of suffixes that shares known prefixes.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller id is removed.

1. Anchors. Of the strings of K = `gram` bytes in a window of `length` bytes, the one with the least hash is the
   window's anchor. Equal windows have their anchor at the same place, so a window that occurs in two documents is
   found at an anchor whose string occurs in two documents. About 2 in length - gram + 2 positions are anchors. Tasks
   send sorted hashes; a range of hashes is put together in one task, which keeps those of two or more documents.
2. Runs. The suffixes at the anchors that are left, with what stands before them, are sorted per shard of documents.
   Equal suffixes are joined: only the one of the least document goes on, the others are known to repeat it. So a
   passage that a third of all documents share sends one entry per shard. A run is front-coded: the length of the
   prefix shared with the entry before, and the bytes that follow.
3. Merge. A range gets the runs of all shards and merges them with a loser tree whose nodes keep the prefix known to
   be shared with the last winner: bytes of it are never compared again. The merged order gives, for each entry, the
   longest prefix it shares with any other, and only windows within it are looked up by their bytes.
4. Removal. Spans go back to the shard of their document, which cuts the bytes.

Texts are exchanged once, by shard; both steps that need them read the same exchange.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _TABLE, batches, prefix_hash, span_hash, text_bytes

#: A byte that UTF-8 never has: stands for what lies beyond a text.
BEYOND = 0xFF
#: Contexts that are cut at a time, and bytes of text whose anchors a task holds.
ROOM, HELD = 1 << 14, 24_000_000


# --- 1: anchors ------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows within the texts, and the hashes of their strings."""
    n = len(data) - gram + 1
    sizes = np.diff(offsets)
    if n < 1 or sizes.max(initial=0) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    h = span_hash(prefix_hash(data), at, at + gram)
    bits = np.uint64(max(28, int(len(data)).bit_length()))
    packed = (h >> bits << bits) | at.astype(np.uint64)
    span, low, width = length - gram + 1, packed, 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = span - width
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    ends = np.repeat(offsets[1:], sizes)[: len(low)]
    inside = np.arange(len(low)) + length <= ends
    places = np.unique((low[inside] & np.uint64((1 << int(bits)) - 1)).astype(np.int64))
    return places, h[places]


def anchor_part(h: np.ndarray, others: int, parts: int) -> np.ndarray:
    """Ranges of 48-bit anchor hashes that hold about equally many anchors; rises with the hash.

    Anchors are least hashes of `others` + 1 strings, so low ones are common: a string of hash x (of 1) is one if at
    least `others` neighbours in a row are above it, by a chance of (1 - x)^others * (1 + others * x). This is its integral.
    """
    y = 1.0 - (h >> 16).astype(np.float64) / 2.0**32
    share = 1.0 - ((others + 2) * y ** (others + 1) - others * y ** (others + 2)) / 2
    return np.clip((share * parts).astype(np.int64), 0, parts - 1)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers at the least width that holds them; the first byte is the width."""
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _loosen(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1])


def _anchor_blobs(length: int, gram: int, parts: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([x[0] for x in held])
            sizes = np.concatenate([x[1] for x in held])
            before = np.cumsum([0, *[int(x[1].sum()) for x in held]])
            places = np.concatenate([x[2] + b for x, b in zip(held, before, strict=False)])
            h = np.concatenate([x[3] for x in held]) >> np.uint64(16)
            held.clear()
            order = np.argsort(h, kind="stable")
            h, places = h[order], places[order]
            part = anchor_part(h, length - gram, parts)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            base = int(ids.min())
            doc = (np.diff(ids, prepend=base).tobytes(), _narrow(sizes))
            rows = [(int(p), int(h[cuts[p]]), base, *doc, _narrow(_steps(h[cuts[p] : cuts[p + 1]].astype(np.int64))), _narrow(places[cuts[p] : cuts[p + 1]])) for p in np.flatnonzero(np.diff(cuts))]
            for at in range(0, len(rows), 16):
                cols = list(zip(*rows[at : at + 16], strict=True))
                yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[3:]]], ["part", "first", "base", "ids", "sizes", "hashes", "places"])

        for batch in batches(source, "text", 1_500_000):
            data, offsets = text_bytes(batch.column(1))
            places, h = anchors(data, offsets, length, gram)
            held.append((np.asarray(batch.column(0)).astype(np.int64), np.diff(offsets), places, h))
            size += len(data)
            if size > HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


def _repeats(shards: int):
    """Anchors whose string more than one document has, sorted into blobs by the documents' shards."""

    def gather(table: pa.Table) -> pa.Table:
        ids, places, hashes = [], [], []
        for first, base, i, s, h, p in zip(*[table[c].to_pylist() for c in ("first", "base", "ids", "sizes", "hashes", "places")], strict=True):
            i = np.cumsum(np.frombuffer(i, np.int64)) + base
            starts = np.cumsum(np.append(0, _wide(s)))
            p = _wide(p)
            row = np.searchsorted(starts, p, "right") - 1
            ids.append(i[row])
            places.append((p - starts[row]).astype(np.uint32))
            hashes.append(np.cumsum(_wide(h)) + first)
        i, p, h = np.concatenate(ids), np.concatenate(places), np.concatenate(hashes)
        del ids, places, hashes
        order = np.argsort(h, kind="stable")
        i, p, h = i[order], p[order], h[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
        size = np.diff(np.append(head, len(h)))
        varied = np.minimum.reduceat(i, head) != np.maximum.reduceat(i, head) if len(h) else np.zeros(0, bool)
        keep = np.repeat(varied, size)
        i, p = i[keep], p[keep]
        shard = shard_of(i, shards)
        order = np.lexsort((p, i, shard))
        i, p, shard = i[order], p[order], shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        rows = []
        for s in np.flatnonzero(np.diff(cuts)):
            own, many = np.unique(i[cuts[s] : cuts[s + 1]], return_counts=True)
            rows.append((int(s), own.tobytes(), _narrow(many), _narrow(p[cuts[s] : cuts[s + 1]])))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "ids": pa.array(cols[1], pa.binary()), "many": pa.array(cols[2], pa.binary()), "places": pa.array(cols[3], pa.binary())})

    return gather


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a document in numpy; `shard_column` gives the same in Spark."""
    return ((ids ^ (ids >> 15)) % 2_147_483_647 * 7919 % shards).astype(np.int32)


def shard_column(shards: int) -> F.Column:
    x = F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 15))
    return F.coalesce(F.pmod(F.pmod(x, F.lit(2_147_483_647)) * 7919, F.lit(shards)), F.lit(0)).cast("int")


# --- 2: runs ---------------------------------------------------------------------------------------------------------


def _contexts(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, at: np.ndarray, right: int, left: int) -> np.ndarray:
    """For each place what follows (`right` bytes) and, backwards, what stands before it (`left` bytes)."""
    steps = np.concatenate([np.arange(right), -1 - np.arange(left)])
    out = np.full((len(at), right + left), BEYOND, np.uint8)
    # The places of all bytes take eight times the room of the bytes: some contexts at a time.
    for lo in range(0, len(at) if len(data) else 0, ROOM):
        where, own = at[lo : lo + ROOM, None] + steps, row[lo : lo + ROOM]
        ok = (where >= offsets[own][:, None]) & (where < offsets[own + 1][:, None])
        np.copyto(out[lo : lo + ROOM], data[np.where(ok, where, 0)], where=ok)
    return out


def front_code(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared prefix with the row before, and the bytes that follow it, of sorted distinct rows."""
    n, width = keys.shape
    lcp = np.zeros(n, np.uint8)
    if n > 1:
        lcp[1:] = np.argmax(keys[1:] != keys[:-1], axis=1)
    return lcp, keys[np.arange(width) >= lcp[:, None]]


def front_decode(lcp: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for k in lcp.tolist():
        to = at + width - k
        last = last[:k] + rest[at:to]
        out.append(last)
        at = to
    return out


def _order_docs(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a shard in an order that doesn't depend on how they came: rows, ids, bytes, offsets."""
    texts = docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_binary())
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    ids = docs["doc_id"].to_pylist()
    raw = texts.to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, raw[k] or b""))
    texts = texts.take(pa.array(order, pa.int64()))
    data, offsets = text_bytes(texts)
    return np.array(order, np.int64), np.array([ids[k] if ids[k] is not None else -1 for k in order], np.int64), data, offsets


def _split(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [_narrow(rows), _narrow(starts), _narrow(ends - starts)]


def _runs(length: int, gram: int, parts: int):
    """Sorted, front-coded runs of a shard, one for each range of anchor strings, and spans that are known already."""
    right, left = length, length - gram

    def make(docs: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("part", "shard", "kind", "a", "b", "c", "d", "e")}
        if docs.num_rows and found.num_rows:
            shard = found["shard"][0].as_py()
            _, ids, data, offsets = _order_docs(docs)
            who, where = [], []
            for i, m, p in zip(found["ids"].to_pylist(), found["many"].to_pylist(), found["places"].to_pylist(), strict=True):
                who.append(np.repeat(np.frombuffer(i, np.int64), _wide(m)))
                where.append(_wide(p))
            who, where = np.concatenate(who), np.concatenate(where)
            # A repeated id names several rows; each is asked for all places, and those outside a text are left out.
            first, last = np.searchsorted(ids, who, "left"), np.searchsorted(ids, who, "right")
            times = last - first
            row = np.repeat(first, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            at = offsets[row] + np.repeat(where, times)
            ok = at + gram <= offsets[row + 1]
            row, at = row[ok], at[ok]
            del who, where
            for piece in _merge_entries(data, offsets, ids, row, at, right, left):
                keys, doc, places, many, spans = piece
                h = np.zeros(len(keys), np.uint64)
                for j in range(gram):
                    h = h * np.uint64(0x100000001B3) + _TABLE[keys[:, j]]
                part = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                heads = np.cumsum(many) - many
                for p in np.unique(part):
                    pick = np.flatnonzero(part == p)
                    lcp, rest = front_code(keys[pick])
                    own = np.repeat(heads[pick] - (np.cumsum(many[pick]) - many[pick]), many[pick]) + np.arange(many[pick].sum())
                    for k, v in zip(out, (int(p), shard, 0, lcp.tobytes(), _squeeze(rest), _squeeze(ids[doc[pick]]), _narrow(doc[pick]), _narrow(np.concatenate([many[pick], places[own]]))), strict=True):
                        out[k].append(v)
                if len(spans[0]):
                    for k, v in zip(out, (shard % parts, shard, 1, *_split(*spans), b"", b""), strict=True):
                        out[k].append(v)
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return make


def _merge_entries(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, row: np.ndarray, at: np.ndarray, right: int, left: int):
    """Sorts suffixes of a shard and joins equal ones: (keys, row, places, places per key, spans of the others)."""
    if not len(at):
        return
    keys = _contexts(data, offsets, row, at, right, left)
    text = np.ascontiguousarray(keys).view(f"S{right + left}").ravel()
    order = np.argsort(text, kind="stable")
    keys = keys[order]
    row, at = row[order], at[order]
    new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    group = np.cumsum(new) - 1
    order = np.lexsort((at, row, group))  # rows are in the order of ids
    row, at = row[order], at[order]
    head = np.flatnonzero(new)
    lead = row[head][group]
    least = row == lead
    other = ~least & (ids[row] > ids[lead])
    # A row with the same id as the least one can't be said to repeat it: it goes on as an entry of its own.
    same = ~least & ~other
    goes = least | same
    cut = np.flatnonzero(goes)
    fresh = np.append(True, (row[cut][1:] != row[cut][:-1]) | (group[cut][1:] != group[cut][:-1]))
    first = cut[fresh]
    many = np.diff(np.append(np.flatnonzero(fresh), len(cut)))
    places = at[cut] - offsets[row[cut]]
    o = np.flatnonzero(other)
    spans = _whole_spans(keys[o], row[o], at[o] - offsets[row[o]], right)
    yield keys[first], row[first], places, many, spans


def _lengths(keys: np.ndarray, right: int) -> tuple[np.ndarray, np.ndarray]:
    beyond = keys == BEYOND
    r = np.where(beyond[:, :right].any(axis=1), beyond[:, :right].argmax(axis=1), right)
    rest = beyond[:, right:]
    return r, np.where(rest.any(axis=1), rest.argmax(axis=1), keys.shape[1] - right)


def _whole_spans(keys: np.ndarray, row: np.ndarray, place: np.ndarray, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of an entry repeat: they cover its context, if that holds a window. Spans are joined per row."""
    r, le = _lengths(keys, right) if len(keys) else (place, place)
    ok = r + le >= right
    return join_spans(row[ok], (place - le)[ok], (place + r)[ok])


def join_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a row that overlap or touch become one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    shift = row * (int(end.max()) + 2)  # rows one behind another, so one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, start[1:] + shift[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return row[head], start[head], (np.maximum.reduceat(end + shift, head) - shift[head])


# --- 3: merge --------------------------------------------------------------------------------------------------------


def loser_tree(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, prefix shared with the entry before) in sorted order of all entries of sorted runs.

    A node holds the run that lost there and the prefix that its entry shares with the winner that passed. Of two
    contenders the one that shares more with the last winner is less; only if both share as much are bytes compared,
    from there on. A run that has ended shares -1.
    """
    k = len(runs)
    if not k:
        return
    width = 1
    while width < k:
        width *= 2
    cur: list[bytes] = [r[1][0] if r[1] else b"" for r in runs] + [b""] * (width - k)
    left = [0 if r[1] else -1 for r in runs] + [-1] * (width - k)
    who, shared = [0] * width, [-1] * width
    level = list(zip(range(width), left, strict=True))
    node = width
    while len(level) > 1:  # play the first round bottom up
        node //= 2
        nxt = []
        for i in range(0, len(level), 2):
            (s, a), (t, b) = level[i], level[i + 1]
            if b > a:
                s, a, t, b = t, b, s, a
            elif a == b and a >= 0:
                x, y, m, n = cur[s], cur[t], 0, len(cur[s])
                while m < n and x[m] == y[m]:
                    m += 1
                if m < n and y[m] < x[m]:
                    s, t = t, s
                b = m
            who[node + i // 2], shared[node + i // 2] = t, b
            nxt.append((s, a))
        level = nxt
    s, a = level[0]
    index = [0] * k
    lcps, keys, sizes = [r[0] for r in runs], [r[1] for r in runs], [len(r[1]) for r in runs]
    n = len(cur[s])
    while a >= 0:
        yield s, index[s], a
        i = index[s] = index[s] + 1
        if i < sizes[s]:
            a, cur[s] = lcps[s][i], keys[s][i]
        else:
            a = -1
        node = (s + width) >> 1
        while node:
            b = shared[node]
            if b > a:
                t = who[node]
                who[node], shared[node] = s, a
                s, a = t, b
            elif b == a and a >= 0:
                t = who[node]
                x, y, m = cur[s], cur[t], a
                while m < n and x[m] == y[m]:
                    m += 1
                if m < n and y[m] < x[m]:
                    who[node] = s
                    s = t
                shared[node] = m
            node >>= 1


def repeated_windows(keys: list[bytes], docs: list[int], shared: list[int], right: int, left: int) -> list[list[int]]:
    """For distinct sorted contexts with one anchor string and their least documents: the offsets of their windows
    that also occur around a smaller document's anchor. shared: prefix in common with the context before.

    A window that begins o bytes before the anchor needs right - o bytes after it, so only offsets within the longest
    prefix shared with a neighbour can repeat; these are looked up by their bytes.
    """
    n, out = len(keys), [[] for _ in keys]
    least: dict[tuple[int, bytes], int] = {}
    spans = []
    for i in range(n):
        key = keys[i]
        r = key.find(BEYOND, 0, right)
        le = key.find(BEYOND, right)
        most = max(shared[i] if i else 0, shared[i + 1] if i + 1 < n else 0)
        most = min(most, right if r < 0 else r)
        spans.append((max(0, right - most), (left if le < 0 else le - right) + 1))
        d = docs[i]
        for o in range(*spans[-1]):
            w = (o, key[: right - o] + key[right : right + o])
            if least.get(w, d) >= d:
                least[w] = d
    for i in range(n):
        key, d = keys[i], docs[i]
        out[i] = [o for o in range(*spans[i]) if least[o, key[: right - o] + key[right : right + o]] < d]
    return out


def _merge(length: int, gram: int):
    right, left = length, length - gram
    width = right + left

    def gather(table: pa.Table) -> pa.Table:
        runs, held = [], []
        spans: dict[int, list] = {}
        for shard, kind, a, b, c, d, e in zip(*[table[x].to_pylist() for x in ("shard", "kind", "a", "b", "c", "d", "e")], strict=True):
            if kind:
                spans.setdefault(shard, []).append((_wide(a), _wide(b), _wide(b) + _wide(c)))
                continue
            lcp = np.frombuffer(a, np.uint8)
            many = _wide(e)
            many, places = many[: len(lcp)], many[len(lcp) :]
            runs.append((lcp.tolist(), front_decode(lcp, _loosen(b, len(lcp) * width - int(lcp.sum(dtype=np.int64))), width)))
            held.append((shard, np.frombuffer(_loosen(c, 8 * len(lcp)), np.int64).tolist(), _wide(d).tolist(), (np.cumsum(many) - many).tolist(), many.tolist(), places.tolist()))
        found: dict[int, array] = {}

        def mark(s: int, i: int, lo: int, hi: int) -> None:
            shard, _, rows, heads, many, places = held[s]
            for p in places[heads[i] : heads[i] + many[i]]:
                found.setdefault(shard, array("q")).extend((rows[i], p - lo, p + hi))

        def settle(group: list[tuple[int, int, int]]) -> None:
            """Entries with one anchor string, sorted."""
            keys: list[bytes] = []
            docs: list[int] = []
            shared: list[int] = []
            owners: list[list[tuple[int, int]]] = []
            for s, i, a in group:
                if a < width or not keys:
                    keys.append(runs[s][1][i])
                    docs.append(held[s][1][i])
                    shared.append(a)
                    owners.append([(s, i)])
                else:
                    docs[-1] = min(docs[-1], held[s][1][i])
                    owners[-1].append((s, i))
            hits = repeated_windows(keys, docs, shared, right, left) if len(keys) > 1 else [[]]
            for key, doc, own, offsets in zip(keys, docs, owners, hits, strict=True):
                r, le = key.find(BEYOND, 0, right), key.find(BEYOND, right)
                r, le = right if r < 0 else r, left if le < 0 else le - right
                for s, i in own:
                    if held[s][1][i] > doc:
                        if r + le >= right:
                            mark(s, i, le, r)
                    else:
                        for o in offsets:
                            mark(s, i, o, right - o)

        group: list[tuple[int, int, int]] = []
        for s, i, a in loser_tree(runs):
            if a < gram:
                if len(group) > 1:
                    settle(group)
                group = []
            group.append((s, i, a))
        if len(group) > 1:
            settle(group)
        for shard, rows in found.items():
            x = np.frombuffer(rows, np.int64).reshape(-1, 3)
            spans.setdefault(shard, []).append((x[:, 0], x[:, 1], x[:, 2]))
        out: list[tuple] = []
        for shard, many in spans.items():
            row, a, b = join_spans(*[np.concatenate([m[k] for m in many]) for k in range(3)])
            out.append((shard, *_split(row, a, b)))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "rows": pa.array(cols[1], pa.binary()), "starts": pa.array(cols[2], pa.binary()), "sizes": pa.array(cols[3], pa.binary())})

    return gather


# --- 4: removal ------------------------------------------------------------------------------------------------------


def _cut(with_text: bool):
    def make(docs: pa.Table, found: pa.Table) -> pa.Table:
        order, ids, data, offsets = _order_docs(docs)
        n = len(order)
        row = a = b = np.zeros(0, np.int64)
        if found.num_rows:
            parts = [(_wide(r), _wide(s), _wide(s) + _wide(z)) for r, s, z in zip(found["rows"].to_pylist(), found["starts"].to_pylist(), found["sizes"].to_pylist(), strict=True)]
            row, a, b = join_spans(*[np.concatenate([p[k] for p in parts]) for k in range(3)])
        drop = np.zeros(len(data) + 1, np.int32)
        np.add.at(drop, a + offsets[row], 1)
        np.add.at(drop, b + offsets[row], -1)
        keep = np.cumsum(drop)[:-1] == 0
        many = np.bincount(row, minlength=n)
        gone = np.bincount(row, b - a, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
        digests, texts = [], []
        cuts = np.cumsum(np.append(0, many))
        for k in range(n):
            x = data[offsets[k] : offsets[k + 1]]
            x = (x[keep[offsets[k] : offsets[k + 1]]] if many[k] else x).tobytes()
            digests.append(hashlib.sha256(x).hexdigest())
            if with_text:
                texts.append(x)
        cols = {"doc_id": docs["doc_id"].combine_chunks().take(pa.array(order)) if n else pa.array([], pa.int64()), "n_bytes": np.diff(offsets), "n_removed": gone, "n_spans": many.astype(np.int64), "kept_sha256": pa.array(digests, pa.string())}
        cols["spans"] = pa.array([[{"start": int(x), "end": int(y)} for x, y in zip(a[cuts[k] : cuts[k + 1]], b[cuts[k] : cuts[k + 1]], strict=True)] for k in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        if with_text:
            cols["kept"] = pa.array(texts, pa.binary())
        return pa.table(cols)

    return make


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 18, with_text: bool = False, shard_bytes: int = 12_000_000) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked for, the bytes kept.

    A null text is empty. A row without a doc_id is neither searched nor cut. Rows with one doc_id don't count as
    repeating each other, as neither id is smaller. Matches don't cross texts. Other columns are ignored. What is kept
    may not be valid UTF-8, as windows are bytes.
    """
    if not 8 <= gram < length <= 255 - 8:
        raise ValueError("need 8 <= gram < length < 248")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    dealt = docs.withColumn("shard", shard_column(shards))
    blobs = docs.where("doc_id IS NOT NULL").mapInArrow(_anchor_blobs(length, gram, shards), "part int, first long, base long, ids binary, sizes binary, hashes binary, places binary")
    return _pipeline(dealt, blobs, shards, length, gram, with_text)


def _pipeline(dealt: DataFrame, blobs: DataFrame, shards: int, length: int, gram: int, with_text: bool) -> DataFrame:
    found = blobs.groupBy("part").applyInArrow(_repeats(shards), "shard int, ids binary, many binary, places binary")
    runs = dealt.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_runs(length, gram, shards), "part int, shard int, kind int, a binary, b binary, c binary, d binary, e binary")
    spans = runs.groupBy("part").applyInArrow(_merge(length, gram), "shard int, rows binary, starts binary, sizes binary")
    kept = ", kept binary" if with_text else ""
    return dealt.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_cut(with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>{kept}")
