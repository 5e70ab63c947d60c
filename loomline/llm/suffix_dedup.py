"""Repeated byte strings by sorted suffixes.

A byte goes when a string of 400 bytes that covers it also starts anywhere else.  Sorting the suffix at every byte would move 400 bytes for each
byte of the corpus, so suffixes are taken at anchors, which stand for all windows around them:

1.  Every 400-byte window has an anchor, the smallest hash of 128 bytes in it (a function of its content).  Neighbouring windows with
    one anchor form a segment: an anchor with up to 272 bytes to its left and up to 400 from its beginning on.  Equal windows have equal
    anchors, at one place of the window.  A segment whose anchor occurs once holds no repeated window and is dropped.
2.  Segments of one content (128 bits of BLAKE2 of their bytes) become one suffix with a count; a count of two or more says that all their windows are repeated.
3.  Where an anchor has several contents, their windows may be equal in part.  Suffixes at anchors go to buckets by sampled splitters of their
    leading bytes; each bucket sorts them by multikey quicksort, and what stands to their left, read backwards, likewise; both orders give the length that
    neighbours share.  The windows that begin ``o`` bytes before their anchors are equal where the suffixes share 400 - o bytes and what is left of
    them o bytes: runs of the two orders, compared for each ``o``.
4.  A run at the end of a bucket may go on in the next one: of its windows, one of each content goes on to buckets by what is left of the anchors, where it
    is compared again; what is at the end of a bucket there too is compared across the boundaries by digests of its 400 bytes.

Splitters are suffixes, then what is left of them, so that an anchor that occurs in a third of all documents is spread over many buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

LENGTH, ANCHOR = 400, 128
#: Most bytes of a window to the left of its anchor.
REACH = LENGTH - ANCHOR
#: Bytes that are hashed together; rows of a batch that are turned into Python objects at once.
CHUNK, ROWS = 1 << 17, 256
#: Measured bytes up to which lists of places are broadcast to the documents; beyond, documents are shuffled to them.
BROADCAST_BYTES = 16 << 20
#: Suffixes in a bucket, about (some 550 bytes each).
BUCKET = 12_000

_r = np.random.default_rng(23)
BYTE_CODES = _r.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_r.integers(2**40, 2**62)) | 5
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        found = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            run = np.full(size, np.uint64(base))
            run[0] = 1
            found.append(np.cumprod(run))
        _powers[:] = found
    return _powers


def prefix_sums(flat: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[flat] * powers(len(flat) + 1)[0][: len(flat)], out=out[1:])
    return out


def mixed_up(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each [start, end) of the bytes behind ``sums``."""
    return mixed_up((sums[end] - sums[start]) * powers(len(sums))[1][start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima of blocks from either end."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(texts: list[bytes]):
    """Lists of (index, offset, bytes) of about CHUNK bytes that hold every window of every text once."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - LENGTH + 1), CHUNK):
            part = t[a : a + CHUNK + LENGTH - 1]
            if held and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield held


def digests(flat: bytes, first, last, shapes=None) -> np.ndarray:
    """128 bits of each stretch of ``flat``, as two signed integers; ``shapes`` (bytes) also count."""
    out = bytearray()
    for i, (x, y) in enumerate(zip(first, last)):
        h = hashlib.blake2b(flat[x:y], digest_size=16)
        if shapes is not None:
            h.update(shapes[i])
        out += h.digest()
    return np.frombuffer(bytes(out), "<i8").reshape(-1, 2)


def segments(texts: list[bytes]):
    """Arrays (text index, start, windows, place of the anchor in the segment, anchor hash, content digest), a set for each chunk."""
    for held in pieces(texts):
        raw = b"".join(p for _, _, p in held)
        flat = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(p) for _, _, p in held])
        starts = ends - np.array([len(p) for _, _, p in held])
        sums = prefix_sums(flat)
        n = len(flat) - ANCHOR + 1
        at = np.arange(n)
        ranked = (span_hash(sums, at, at + ANCHOR) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
        anchor = (sliding_min(ranked, REACH + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        window = np.arange(len(anchor))
        piece = np.repeat(np.arange(len(held)), ends - starts)[: len(anchor)]
        inside = window + LENGTH <= ends[piece]
        begins = inside.copy()
        begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (piece[1:] != piece[:-1])
        first = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= begins[1:] | ~inside[1:]
        last = np.flatnonzero(stops)
        a = anchor[first]
        shapes = (a - first).astype("<u2")[:, None].view(np.uint8)
        content = digests(raw, first.tolist(), (last + LENGTH).tolist(), [x.tobytes() for x in shapes])
        who = piece[first]
        index, offset = np.array([i for i, _, _ in held])[who], np.array([o for _, o, _ in held])[who]
        yield index, first - starts[who] + offset, last - first + 1, a - first, span_hash(sums, a, a + ANCHOR).view(np.int64), content


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (big-endian words of their bytes), and the bytes that each shares with the one before it in that order.

    Multikey quicksort, all stretches at a time: a level orders by one word the rows that are equal so far, and only
    those that stay equal are looked at by the next.
    """
    n, depth = words.shape
    order, shared, new = np.arange(n), np.full(n, 8 * depth), np.zeros(n, dtype=bool)
    new[:1], shared[:1] = True, 0
    for d in range(depth):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        stretch, w = np.cumsum(new)[at], words[order[at], d]
        by = np.lexsort((w, stretch))
        order[at], w = order[at][by], w[by]
        differ = np.flatnonzero((w[1:] != w[:-1]) & (stretch[1:] == stretch[:-1])) + 1
        bits = w[differ] ^ w[differ - 1]
        shared[at[differ]] = 8 * d + sum((bits < np.uint64(1 << 64 - 8 * k)).astype(np.int64) for k in range(1, 8))
        new[at[differ]] = True
    return order, shared


def as_words(strings: list[bytes], length: int) -> np.ndarray:
    """The strings, filled with zeros, as rows of big-endian words."""
    return np.frombuffer(b"".join([s.ljust(length, b"\0") for s in strings]), ">u8").reshape(len(strings), length // 8).astype(np.uint64)


def compared(left: list[bytes], right: list[bytes], active: np.ndarray, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows ``active`` of some segments: which equal another, and one of each content whose run is at an end of the order, which others may share.

    Both, as ``active``, are boolean arrays (segments, REACH + 1): the window that begins ``o`` bytes before the anchor.  ``left`` is read backwards.
    """
    by_right, shared_right = multikey(as_words(right, LENGTH))
    by_left, shared_left = multikey(as_words(left, REACH))
    size = len(active)
    hit, edge = np.zeros(active.shape, dtype=bool), np.zeros(active.shape, dtype=bool)
    run, runs = np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64)
    for o in np.flatnonzero(active.any(axis=0)).tolist():
        here = np.flatnonzero(active[:, o])
        runs[by_right] = np.cumsum(shared_right < LENGTH - o)
        run[by_left] = np.cumsum(shared_left < o) if o else 0
        main, order = (runs, by_right) if by_suffix else (run, by_left)
        key = runs[here] * (size + 1) + run[here]
        by = np.argsort(key, kind="stable")
        key, who = key[by], here[by]
        same = key[1:] == key[:-1]
        first = np.append(True, ~same)
        equal = ~first
        equal[:-1] |= same
        hit[who[equal], o] = True
        edge[who[first & np.isin(main[who], main[order[[0, -1]]])], o] = True
    return hit, edge


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of 128 bits that tells rows with different contents apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("row", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))))


def segment_table(rows: DataFrame) -> DataFrame:
    """Segments of every text: row, start, n (windows), at (place of the anchor), anchor (hash), c1 and c2 (digest of the content)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                for index, start, n, at, anchor, content in segments([t.encode() for t in some.column("text").to_pylist()]):
                    ints = [pa.array(x.astype(np.int32)) for x in (start, n, at)]
                    longs = [pa.array(x) for x in (anchor, content[:, 0].copy(), content[:, 1].copy())]
                    yield pa.RecordBatch.from_arrays([some.column("row").take(pa.array(index)), *ints, *longs], names=["row", "start", "n", "at", "anchor", "c1", "c2"])

    return rows.select("row", "text").mapInArrow(run, "row binary, start int, n int, at int, anchor long, c1 long, c2 long")


def shared_segments(segs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Segments (row, start, n) that are there more than once; one of each content whose anchor has several, by row; number of these.

    An open segment is one integer: start, whether there are copies of it, n and at.
    """
    uniform = (F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2"))
    anchors = segs.groupBy("anchor").agg(F.count("*").alias("c"), uniform.alias("uniform")).where("c > 1")
    anchors = settle(anchors.select("anchor", "uniform"), "anchors")  # written, so that the join may split a common anchor
    shared = settle(segs.join(anchors, "anchor"), "shared-segments")
    mixed = shared.where("not uniform")
    kinds = mixed.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "n", "at")).alias("s"))
    kinds = settle(kinds, "segment-kinds")
    copied = mixed.join(kinds.where("copies > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"], "left_semi")
    known = shared.where("uniform").select("row", "start", "n").unionByName(copied.select("row", "start", "n"))
    code = F.col("s.start").cast("long") * (1 << 21) + F.when(F.col("copies") > 1, 1 << 20).otherwise(0) + F.col("s.n") * (1 << 10) + F.col("s.at")
    places = kinds.groupBy("s.row").agg(F.collect_list(code).alias("places"))
    return known, settle(places, "open-places"), kinds.count()


def with_places(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``places`` (row, places) on row; the places are broadcast if their measured size allows."""
    measured = places.agg(F.sum(F.size("places") * 8 + 48)).first()[0] or 0
    return rows.join(F.broadcast(places) if measured <= BROADCAST_BYTES else places, "row", how)


SUFFIX = "row binary, start int, n int, at int, copied boolean, left binary, right binary"


def suffix_table(opened: DataFrame) -> DataFrame:
    """The open segments of ``opened`` (row, text, places) with their bytes: to the left of the anchor, backwards, and from it on."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                code = batch.column("places")[i].values.to_numpy()
                start, copied, n, at = code >> 21, (code >> 20 & 1).astype(bool), code >> 10 & 1023, code & 1023
                data = batch.column("text")[i].as_py().encode()
                for a in range(0, len(code), 2048):
                    b = a + 2048
                    cuts = list(zip(start[a:b].tolist(), at[a:b].tolist(), n[a:b].tolist()))
                    ints = [pa.array(x[a:b].astype(np.int32)) for x in (start, n, at)]
                    left, right = [data[s : s + m][::-1] for s, m, _ in cuts], [data[s + m : s + k + LENGTH - 1] for s, m, k in cuts]
                    row = pa.array([batch.column("row")[i].as_py()] * len(cuts), pa.binary())
                    yield pa.RecordBatch.from_arrays([row, *ints, pa.array(copied[a:b]), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["row", "start", "n", "at", "copied", "left", "right"])

    return opened.select("row", "text", "places").mapInArrow(run, SUFFIX)


def _stretches(segments, found: np.ndarray, names: list[str]):
    """An Arrow batch of the windows ``found`` of ``segments`` (a table), neighbours together: row, start, n, and nulls for the other columns."""
    import pyarrow as pa

    marked = np.zeros((len(found), REACH + 3), dtype=bool)
    marked[:, 1:-1] = found
    who, low = np.nonzero(marked[:, 1:] & ~marked[:, :-1])
    _, high = np.nonzero(marked[:, :-1] & ~marked[:, 1:])
    anchor = (segments.column("start").to_numpy() + segments.column("at").to_numpy())[who]
    kinds = {"left": pa.binary(), "right": pa.binary(), "edge": pa.binary(), "known": pa.binary(), "at": pa.int32(), "d1": pa.int64(), "d2": pa.int64(), "open": pa.bool_()}
    columns = {"row": segments.column("row").combine_chunks().take(pa.array(who)), "start": pa.array((anchor - high + 1).astype(np.int32)), "n": pa.array((high - low).astype(np.int32))}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(who), kinds.get(c))) for c in names], names=names)


def _bits(x: np.ndarray):
    import pyarrow as pa

    return pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())


def _mask(column) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(flat, axis=1)[:, : REACH + 1].astype(bool)


def _whole(batches):
    """A bucket as one table; None if it is empty."""
    import pyarrow as pa

    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def by_suffixes(suffixes: DataFrame, parts: int) -> DataFrame:
    """Repeated windows (row, start, n; at is null), and the segments with windows at the ends of buckets (edge: these windows; known: those of them known to be repeated)."""
    names = ["row", "start", "n", "at", "left", "right", "edge", "known"]

    def run(batches):
        import pyarrow as pa

        if (t := _whole(batches)) is None:
            return
        at, n, o = t.column("at").to_numpy()[:, None], t.column("n").to_numpy()[:, None], np.arange(REACH + 1)
        active, copied = (o <= at) & (o > at - n), t.column("copied").to_numpy()[:, None]
        hit, edge = compared(t.column("left").to_pylist(), t.column("right").to_pylist(), active, True)
        yield _stretches(t, hit & ~copied, names)
        some = np.flatnonzero(edge.any(axis=1))
        t = t.take(pa.array(some)).combine_chunks()
        yield from t.append_column("edge", _bits(edge[some])).append_column("known", _bits((hit | copied)[some])).select(names).to_batches()

    dealt = suffixes.repartitionByRange(parts, "right", "left", "row", "start")
    return dealt.mapInArrow(run, "row binary, start int, n int, at int, left binary, right binary, edge binary, known binary")


def by_lefts(edges: DataFrame, parts: int) -> DataFrame:
    """Repeated windows (row, start, n; open is null), and windows at the ends of buckets with their digest; open: not known to be repeated."""
    names = ["row", "start", "n", "open", "d1", "d2"]

    def run(batches):
        import pyarrow as pa

        if (t := _whole(batches)) is None:
            return
        left, right, known = t.column("left").to_pylist(), t.column("right").to_pylist(), _mask(t.column("known"))
        hit, edge = compared(left, right, _mask(t.column("edge")), False)
        yield _stretches(t, hit & ~known, names)
        known |= hit
        who, o = np.nonzero(edge)
        anchor, row = t.column("start").to_numpy() + t.column("at").to_numpy(), t.column("row").combine_chunks()
        for a in range(0, len(who), 1 << 16):
            w, x = who[a : a + (1 << 16)], o[a : a + (1 << 16)]
            whole = [left[i][:k][::-1] + right[i][: LENGTH - k] for i, k in zip(w.tolist(), x.tolist())]
            d = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in whole), "<i8").reshape(-1, 2)
            ints = [pa.array(y.astype(np.int32)) for y in (anchor[w] - x, np.ones(len(w)))]
            yield pa.RecordBatch.from_arrays([row.take(pa.array(w)), *ints, pa.array(~known[w, x]), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=names)

    dealt = edges.repartitionByRange(parts, "left", "right", "row", "start")
    return dealt.mapInArrow(run, "row binary, start int, n int, open boolean, d1 long, d2 long")


def repeated_windows(suffixes: DataFrame, n: int) -> DataFrame:
    """row, start, n of the windows that equal others, of the ``n`` segments of ``suffixes``."""
    least = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = settle(by_suffixes(suffixes, max(least, -(-n // BUCKET))), "compared-suffixes")
    edges = first.where("at is not null")
    second = settle(by_lefts(edges, max(1, -(-edges.count() // BUCKET))), "compared-lefts")
    at_ends = second.where("open is not null")
    across = at_ends.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2")
    across = at_ends.where("open").join(across, ["d1", "d2"], "left_semi")
    return first.where("at is null").select("row", "start", "n").unionByName(second.where("open is null").select("row", "start", "n")).unionByName(across.select("row", "start", "n"))


def merged(segs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["start"] + s["n"] + LENGTH - 1) for s in segs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_places(docs: DataFrame) -> DataFrame:
    """row, places: maximal runs of repeated bytes (start * 2 ** 32 + end) in each row of ``_rows(docs)`` that has any."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                spans = [[(a << 32) + b for a, b in merged(s)] for s in some.column("segments").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("row"), pa.array(spans, pa.list_(pa.int64()))], names=["row", "places"])

    rows = _rows(docs)
    known, places, n = shared_segments(settle(segment_table(rows), "segments"))
    found = known.unionByName(repeated_windows(suffix_table(with_places(rows.select("row", "text"), places, "inner")), n))
    grouped = found.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("segments"))
    return settle(grouped.mapInArrow(run, "row binary, places array<long>"), "repeated-places")


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets); one row for each row of ``docs``.

    Null texts count as empty and, like all texts under 400 bytes, lose nothing; rows that are there twice repeat each other; a null
    doc_id is kept; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some, out = batch.slice(first, ROWS), []
                for text, places in zip(some.column("text").to_pylist(), some.column("places").to_pylist()):
                    data, spans = text.encode(), [(p >> 32, p & 0xFFFFFFFF) for p in places or ()]
                    out.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(data, spans)).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)))
                types = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    rows = with_places(_rows(docs), repeated_places(docs), "left").select("doc_id", "text", "places")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substring(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
k AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
repeated AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM w SEMI JOIN k USING (k)),
runs AS (SELECT r, i, sum(CASE WHEN i <= p + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM repeated),
spans AS (SELECT r, g, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, g),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans),
kept AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS h
  FROM cut JOIN d USING (r) GROUP BY r
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN kept USING (r)
"""
