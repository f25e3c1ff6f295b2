"""N-gram Jaccard join: documents whose word 3-gram sets reach a Jaccard similarity, as classes and links.

Parity sketches. A set is cut into chunks by a hash of its grams; each chunk is the XOR of 64-bit
patterns of its grams, so a gram in one set but not the other changes one chunk, and the number
of differing chunks bounds the symmetric difference from below. Per size band the differences
that the threshold allows are spread over the chunks, so that by the pigeonhole principle some
chunk stays equal; sets meet when a chunk is equal. Pairs whose smaller set has fewer than 64
grams have grams for chunks, half of them and one more, of which two sets at the threshold share
one without fail, whatever the order in which all sets choose them: grams that more than FREQUENT
such sets have are chosen last, so that few sets meet by what many have. Of longer sets KEYS chunks are tried, where about as many exist as grams may
differ (of several splits into chunks, where one has too few); that fails with a chance of at
most 1 in 1,500 at the very threshold, for the least favourable sizes, and less above it. A dense one-bit parity sketch then rejects pairs whose
Hamming distance exceeds the allowed difference, and the rest are verified exactly.

Result: one row per document with its class (the least doc_id of its connected component) and the
number of other documents it is linked to. Sets that are equal are joined once and count as many
times as they have documents; links between different sets are counted, never listed: a group of
sets that share a chunk is verified in blocks of bounded size, each pair only in the first chunk it
shares, and yields one row per set. Keys that are hot in a partition are cut into blocks before
they are shuffled, so no task receives all members of a large group. Groups go where their least set
goes, which near copies have in common, so that a text travels seldom and not once a group.

Defined results: a row with a NULL doc_id or text, or a text without words, has no row in the
result; a text of fewer than three words counts as one gram; rows with the same doc_id and the
same grams are one document, and a doc_id with different sets has a row for each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from driftglass.llm._common import broadcast_if_small, column, components, key_groups, materialise, mix, released, runs, shingle_hashes, slices, token_hashes, U64, whole_partition

GRAM, THRESHOLD, KEYS = 3, 0.5, 96
#: Where the smaller set is in a band up to this one, the keys are grams.
SHORT = 5
#: Grams that the sets of one block may have, and the most sets; larger groups are verified block by block.
BLOCK_GRAMS, BLOCK_SETS = 1 << 19, 1024
#: Grams that the sets of groups with the same least set have, counted once a group, of which one cell verifies the groups.
CELL_GRAMS = 1 << 21
#: A key with so many sets in one partition may be hot everywhere.
LOCALLY_HOT = 64
#: A gram that more short sets have is frequent; of so many, the most frequent ones, all sets know how frequent they are.
FREQUENT, MOST_KNOWN = 256, 1 << 18
_SKETCH_BITS = 1024
_MASK = U64((1 << 48) - 1)
#: A row's place: its band of meeting times _BAND, plus _LOW where its own band is one above, plus the chunk.
_BAND, _LOW = 512, 256


def gram_set(text: str) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the word n-grams."""
    tokens = token_hashes(text)
    return np.unique(shingle_hashes(tokens, min(GRAM, len(tokens))) & _MASK) if len(tokens) else np.empty(0, U64)


def band_of(n: int) -> int:
    """Bands double in size; at a threshold of one half partners are in the same or the next band."""
    return int(n).bit_length() - 1


def block_sets(band: int, most: int) -> int:
    """Sets of a band, and of the next, that one block may hold."""
    return max(2, min(most, BLOCK_GRAMS >> (band + 1)))


class Frequent:
    """How frequent the frequent grams of short sets are, as powers of two; that orders all grams."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        order = np.argsort(grams)
        self.grams = grams[order]
        self.level = np.minimum(np.log2(n[order].astype(float)).astype(np.int64) + 1, 63).astype(U64)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), U64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.level[at], U64(0))


_NONE_FREQUENT = Frequent(np.empty(0, U64), np.empty(0, np.int64))


def chunk_keys(grams: np.ndarray, band: int, frequent: Frequent = _NONE_FREQUENT) -> np.ndarray:
    """Keys for pairs whose smaller set is in band: of the first KEYS chunks, 0 where a chunk says too little, or of grams."""
    if band <= SHORT:  # of two sets that reach one half, these least grams have one in common; frequent ones are large
        keys = mix(mix(grams ^ U64(0x5BD1E995)) + U64(band)) >> U64(6) | frequent.levels(grams) << U64(58)
        return np.sort(keys | U64(1))[: len(grams) // 2 + 1]
    # about as many chunks as grams may differ: more would be too small, in fewer none stays equal
    at, pattern = [], mix(grams)
    for split in range(-(-KEYS >> band)):
        at.append(((mix(grams ^ U64(0x5BD1E995 + split)) >> U64(16)) & U64((1 << band) - 1)) + U64(split << band))
    at = np.concatenate(at)
    near = at < KEYS
    pattern, at = np.tile(pattern, len(at) // len(grams))[near], at[near].astype(np.int64)
    out = np.zeros(KEYS, U64)
    np.bitwise_xor.at(out, at, pattern)
    filled = np.bincount(at, minlength=KEYS) >= 2
    keys = mix(out ^ mix(np.arange(KEYS, dtype=U64) + U64(band * 1000 + 1))) | U64(1)
    return np.where(filled, keys, U64(0))


def parity_sketch(grams: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((mix(grams ^ U64(0x1234567)) % U64(_SKETCH_BITS)).astype(np.int64), minlength=_SKETCH_BITS) & 1).astype(np.uint8).view(np.uint64)


def set_id(grams: np.ndarray) -> int:
    return xxh3_64_intdigest(grams.tobytes())


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, U64).view(np.int64), pa.int64())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text; where a partition has the set for the first time, its keys, and its grams if some of its keys are grams."""
    seen: set[int] = set()
    for b in slices(batches):
        kept, sids, keys, place, grams = [], [], [], [], []
        for k, text in enumerate(b.column(2).to_pylist()):
            g = gram_set(text)
            if not len(g):
                continue
            kept.append(k)
            sids.append(set_id(g))
            if sids[-1] in seen:
                keys.append(None)
                place.append(None)
                grams.append(None)
                continue
            seen.add(sids[-1])
            own, low = band_of(len(g)), band_of(len(g)) - 1
            found = [(x, np.flatnonzero(x) + at) for band, at in ((own, own * _BAND), (low, low * _BAND + _LOW)) if band > SHORT for x in (chunk_keys(g, band),)]
            keys.append(np.concatenate([x[x > 0] for x, _ in found] or [g[:0]]).view(np.int64))
            place.append(np.concatenate([at for _, at in found] or [np.empty(0, np.int64)]).astype(np.int16))
            grams.append(g.view(np.int64) if low <= SHORT else None)
        rows = b.take(pa.array(kept, pa.int64()))
        lists = {"keys": pa.array(keys, pa.list_(pa.int64())), "place": pa.array(place, pa.list_(pa.int16())), "grams": pa.array(grams, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "fp": rows.column(1), "sid": _signed(sids), **lists})


def _with_gram_keys(frequent: Frequent):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of short sets: grams beside chunks."""
        for b in slices(batches):
            keys, place = [], []
            for k, at, g in zip(b.column(1), b.column(2), b.column(3), strict=True):
                g = g.values.to_numpy().view(U64)
                own, low = band_of(len(g)), band_of(len(g)) - 1
                found = [(chunk_keys(g, band, frequent).view(np.int64), where) for band, where in ((own, own * _BAND), (low, low * _BAND + _LOW)) if 0 <= band <= SHORT]
                keys.append(np.concatenate([k.values.to_numpy(), *(x for x, _ in found)]))
                place.append(np.concatenate([at.values.to_numpy(), *(np.full(len(x), where) for x, where in found)]).astype(np.int16))
            yield pa.RecordBatch.from_pydict({"sid": b.column(0), "keys": pa.array(keys, pa.list_(pa.int64())), "place": pa.array(place, pa.list_(pa.int16()))})

    return add


def _frequent(described: DataFrame, least: int) -> Frequent:
    """The grams that more than least of the short sets have."""
    n = described.where("grams is not null").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(f"n > {least}")
    found = n.orderBy(F.desc("n"), "gram").limit(MOST_KNOWN).toArrow()
    return Frequent(column(found, "gram").view(U64), column(found, "n")) if found.num_rows else _NONE_FREQUENT


def _locally_hot(least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys that many sets of a partition have, counted slice by slice: those that are rare in a slice are let go."""
        found: dict[int, list[int]] = {}
        for b in slices(batches, 20_000):
            keys, at, n = np.unique(b.column(0).flatten().to_numpy(), return_index=True, return_counts=True)
            place = b.column(1).flatten().to_numpy()
            for k in np.flatnonzero(n > 1).tolist():
                if (key := int(keys[k])) in found:
                    found[key][1] += int(n[k])
                elif n[k] >= least // 8:
                    found[key] = [int(place[at[k]]) // _BAND, int(n[k])]
        hot = [(k, *v) for k, v in found.items() if v[1] >= least]
        yield pa.RecordBatch.from_pydict({"key": pa.array([h[0] for h in hot], pa.int64()), "band": pa.array([h[1] for h in hot], pa.int32()), "n": pa.array([h[2] for h in hot], pa.int64())})

    return find


def _meet(most: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of two or more sets that share a chunk, in blocks, one row each, from rows partitioned by key and cell."""
        table = whole_partition(batches)
        if table is None:
            return
        key, cell, side, sid, place = (column(table, c) for c in ("key", "cell", "side", "sid", "place"))
        order = np.lexsort((sid, side, cell, key))
        same = np.concatenate(([False], np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (key, cell, sid)])))
        order = order[~same]  # partitions that have the same set
        key, cell, side, sid, place = (x[order] for x in (key, cell, side, sid, place))
        names = ("members", "first", "root", "weight", "left", "right")
        out: dict[str, list] = {k: [] for k in names}
        starts, sizes = runs(mix(key.view(U64)) + cell.view(U64))
        wide = sizes > 1
        starts, sizes = starts[wide], sizes[wide]
        own = np.concatenate(([0], np.cumsum(place % _BAND < _LOW)))
        has_own = own[starts + sizes] > own[starts]
        for s, n in zip(starts[has_own].tolist(), sizes[has_own].tolist(), strict=True):
            ids, band = sid[s : s + n], int(place[s]) // _BAND
            first = int(key[s].view(np.uint64) >> U64(1)) if band <= SHORT else int(place[s]) % _LOW
            low = place[s : s + n] % _BAND >= _LOW
            if side[s + n - 1]:
                parts = [(np.flatnonzero(side[s : s + n] == 1), np.flatnonzero(side[s : s + n] == 2))]
            else:
                step = block_sets(band, most)
                cuts = [np.arange(i, min(i + step, n)) for i in range(0, n, step)]
                parts = [(a, b if j else cuts[0][:0]) for i, a in enumerate(cuts) for j, b in enumerate(cuts[i:])]
            for a, b in parts:
                if len(a) and (len(b) or len(a) > 1):
                    # groups of the same sets in the same roles do the same work
                    out["members"].append(xxh3_64_intdigest(b"%d:%d:" % (band, len(a)) + ids[a].tobytes() + ids[b].tobytes() + low[a].tobytes() + low[b].tobytes()))
                    out["first"].append(band << 58 | first >> 6 if band <= SHORT else band << 58 | first)
                    out["root"].append(min(ids[part].min() for part in (a, b) if len(part)))
                    out["weight"].append(len(a) + len(b) << band + 1)
                    out["left"].append(ids[a])
                    out["right"].append(ids[b])
            if len(out["left"]) >= 5000:
                yield _groups(out)
                out = {k: [] for k in names}
        yield _groups(out)

    return meet


def _groups(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"members": _signed(out["members"]), "first": _signed(out["first"]), "root": pa.array(out["root"], pa.int64()), "weight": pa.array(out["weight"], pa.int64()), "left": pa.array(out["left"], pa.list_(pa.int64())), "right": pa.array(out["right"], pa.list_(pa.int64()))})


class _Sets:
    """The sets that a cell verifies, each read, sketched and cut into chunks once for all its groups."""

    def __init__(self, frequent: Frequent):
        self.frequent = frequent
        self.place: dict[int, int] = {}
        self.grams: list[np.ndarray] = []
        self.sketches: list[np.ndarray] = []
        self.n_docs: list[int] = []
        self.keys: dict[tuple[int, int], np.ndarray] = {}

    def add(self, sid: int, n: int, grams: np.ndarray) -> None:
        self.place[sid] = len(self.grams)
        self.grams.append(grams)
        self.sketches.append(parity_sketch(grams))
        self.n_docs.append(n)

    def keys_of(self, at: int, band: int) -> np.ndarray:
        if (at, band) not in self.keys:
            self.keys[at, band] = chunk_keys(self.grams[at], band, self.frequent)
        return self.keys[at, band]


class _Block:
    """Some sets with their lengths, parity sketches and keys."""

    def __init__(self, known: _Sets, places: np.ndarray, band: int):
        self.known, self.places, self.band = known, places.tolist(), band
        self.sets = [known.grams[k] for k in self.places]
        self.length = np.array([len(g) for g in self.sets])
        self.sketch = np.stack([known.sketches[k] for k in self.places])
        self.low = np.array([band_of(n) > band for n in self.length.tolist()])

    def keys_before(self, first: int) -> list[np.ndarray]:
        """Each set's keys by which it has met others before this group, sorted."""
        keys = (self.known.keys_of(k, self.band) for k in self.places)
        if self.band <= SHORT:
            return [k[k >> U64(7) < U64(first)] for k in keys]
        return [np.sort(k[:first][k[:first] > 0]) for k in keys]


def common_grams(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many grams left[i] and right[j] have in common: one by one where pairs are few, else as products of 0-1 matrices."""
    if len(i) * 50 < len(left) * len(right) or len(i) < 8:
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    ends = [np.repeat(np.arange(len(side)), [len(g) for g in side]) for side in (left, right)]
    values, code, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = n > 1
    code = np.where(shared[code], np.cumsum(shared)[code] - 1, -1)
    codes = code[: len(ends[0])], code[len(ends[0]) :]
    total = np.zeros((len(left), len(right)), np.float32)
    for t in range(0, int(shared.sum()), 4096):
        tile = []
        for side, end, c in zip((left, right), ends, codes, strict=True):
            here = (c >= t) & (c < t + 4096)
            m = np.zeros((len(side), 4096), np.float32)
            m[end[here], c[here] - t] = 1
            tile.append(m)
        total += tile[0] @ tile[1].T
    return total[i, j].astype(np.int64)


def linked(left: _Block, right: _Block | None, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of left with right, or within left, that have not met before this group's first chunk or gram."""
    within, right = right is None, left if right is None else right
    length, other = left.length[:, None], right.length[None, :]
    ok = (np.minimum(length, other) >= THRESHOLD * np.maximum(length, other)) & ~(left.low[:, None] & right.low[None, :])
    if within:
        ok &= np.arange(len(left.sets))[:, None] < np.arange(len(right.sets))[None, :]
    i, j = np.nonzero(ok)
    differ = np.zeros(len(i), np.int64)
    for s in range(0, len(i), 65536):
        differ[s : s + 65536] = np.bitwise_count(left.sketch[i[s : s + 65536]] ^ right.sketch[j[s : s + 65536]]).sum(1)
    near = differ <= (1 - THRESHOLD) / (1 + THRESHOLD) * (left.length[i] + right.length[j]) + 1e-9
    i, j = i[near], j[near]
    before = [x.keys_before(first) for x in (left, right)]
    new = common_grams(*before, i, j) == 0
    i, j = i[new], j[new]
    common = common_grams(left.sets, right.sets, i, j)
    true = common >= THRESHOLD * (left.length[i] + right.length[j] - common)
    return i[true], j[true]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: they travel packed."""
    packer = zstandard.ZstdCompressor(level=3)
    for b in slices(batches):
        texts = b.column(2).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_pydict({"sid": b.column(0), "n": b.column(1), "packed": pa.array(map(packer.compress, texts), pa.binary())})


def _verify(frequent: Frequent):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(sid, root, links) of the sets of each group that have links in it, from cells of texts and groups; root is a set they are connected with."""
        unpacker = zstandard.ZstdDecompressor()
        for table in key_groups(batches, "root", "cell"):
            starts, sizes = runs(mix(column(table, "root").view(U64)) + column(table, "cell").view(U64))
            rows: list[list[np.ndarray]] = [[], [], []]
            for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                cell, known = table.slice(s, n), _Sets(frequent)
                texts = cell.filter(cell.column("packed").is_valid())
                for sid, docs, packed in zip(*(texts.column(c).to_pylist() for c in ("sid", "n", "packed")), strict=True):
                    if sid not in known.place:
                        known.add(sid, docs, gram_set(unpacker.decompress(packed).decode("utf-8", "replace")))
                groups = cell.filter(cell.column("first").is_valid())
                for first, *sides in zip(*(groups.column(c).to_pylist() for c in ("first", "left", "right")), strict=True):
                    for k, v in enumerate(_links(known, first, *sides)):
                        rows[k].append(v)
            if rows[0]:
                yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v)) for c, v in zip(("sid", "root", "links"), rows, strict=True)})

    return verify


def _links(known: _Sets, first: int, left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sid, root, links) of one group."""
    band, first = first >> 58, first & ((1 << 58) - 1)
    sids = np.array(left + right, np.int64)
    place = np.array([known.place[sid] for sid in sids.tolist()])
    a, b = place[: len(left)], place[len(left) :]
    i, j = linked(_Block(known, a, band), _Block(known, b, band) if len(b) else None, first)
    j = j + (len(a) if len(b) else 0)
    label = np.arange(len(place))
    while True:  # of each connected part its first set
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    weight = np.array(known.n_docs, float)[place]
    links = np.bincount(i, weight[j], len(place)) + np.bincount(j, weight[i], len(place))
    some = np.flatnonzero(links)
    return sids[some], sids[label[some]], links[some].astype(np.int64)


def _rows(described: DataFrame, frequent: Frequent, most: int, least: int) -> DataFrame:
    """(key, cell, side, sid, place) of every set; cell is 0, or says which two blocks of a hot key meet, and side in which of them the set is."""
    short = described.where("grams is not null").select("sid", "keys", "place", "grams").mapInArrow(released(_with_gram_keys(frequent)), "sid bigint, keys array<bigint>, place array<smallint>")
    keyed = described.where("keys is not null and grams is null").select("sid", "keys", "place").unionByName(short)
    rows = keyed.select("sid", F.explode(F.arrays_zip("keys", "place")).alias("k")).select(F.col("k.keys").alias("key"), "sid", F.col("k.place").alias("place"))
    hot = keyed.select("keys", "place").mapInArrow(released(_locally_hot(least)), "key bigint, band int, n bigint").groupBy("key").agg(F.min("band").alias("band"), F.sum("n").alias("n"))
    room = F.greatest(F.lit(2), F.least(F.lit(most), F.expr(f"shiftright({BLOCK_GRAMS}, band + 1)")))
    hot = materialise(hot.select("key", F.ceil(F.col("n") / room).cast("bigint").alias("blocks")).where("blocks > 1"), "ngram-hot")
    if not hot.count():
        return rows.select("key", F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("tinyint").alias("side"), "sid", "place")
    rows = rows.join(broadcast_if_small(hot, 24), "key", "left").withColumn("own", F.pmod(F.xxhash64("sid", F.lit(3)), "blocks"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    side = F.when(F.col("x") == F.col("own"), 0).when(F.col("own") < F.col("x"), 1).otherwise(2)
    cell = F.shiftleft(F.least("x", "own"), 31) + F.greatest("x", "own")
    return rows.select("key", F.coalesce(cell, F.lit(0)).cast("bigint").alias("cell"), F.when(F.col("blocks").isNull(), 0).otherwise(side).cast("tinyint").alias("side"), "sid", "place")


def _classes(docs: DataFrame, most: int = BLOCK_SETS, least: int = LOCALLY_HOT, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, fp, sid), fp the fingerprint of a text, and sets (sid, class_id, n_links)."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("fp"), "text")
    # keys of a set stay with one row of each partition that has it
    described = materialise(texts.mapInArrow(released(_describe), "doc_id bigint, fp bigint, sid bigint, keys array<bigint>, place array<smallint>, grams array<bigint>"), "ngram-described")
    sets = described.groupBy("sid", "doc_id").agg(F.min("fp").alias("fp")).groupBy("sid").agg(F.min(F.struct("doc_id", "fp")).alias("rep"), F.count("*").alias("n"))
    sets = materialise(sets.select("sid", F.col("rep.doc_id").alias("rep"), F.col("rep.fp").alias("fp"), "n"), "ngram-sets")
    known = _frequent(described, frequent)
    rows = _rows(described, known, most, least)
    groups = rows.repartition("key", "cell").mapInArrow(released(_meet(most)), "members bigint, first bigint, root bigint, weight bigint, left array<bigint>, right array<bigint>")
    # groups of the same sets do the same work: one of them, with the first chunk, stands for all
    groups = groups.groupBy("members").agg(F.min_by(F.struct("first", "root", "weight", "left", "right"), "first").alias("g"))
    groups = materialise(groups.select("members", "g.*"), "ngram-groups")
    cells = materialise(groups.groupBy("root").agg(F.ceil(F.sum("weight") / CELL_GRAMS).alias("cells")).where("cells > 1"), "ngram-cells")
    groups = groups.join(broadcast_if_small(cells, 24), "root", "left").withColumn("cell", F.coalesce(F.pmod("members", "cells"), F.lit(0).cast("bigint")))
    shipped = materialise(groups.select("root", "cell", F.explode(F.concat("left", "right")).alias("sid")).distinct(), "ngram-shipped")
    wanted = materialise(sets.join(broadcast_if_small(shipped.select("sid").distinct(), 16), "sid", "left_semi"), "ngram-wanted")
    asked = texts.join(broadcast_if_small(wanted.select(F.col("rep").alias("doc_id"), "fp", "sid", "n"), 48), ["doc_id", "fp"]).select("sid", "n", "text")
    asked = asked.mapInArrow(released(_pack), "sid bigint, n bigint, packed binary")
    sent = asked.join(broadcast_if_small(shipped, 32), "sid").select("root", "cell", "sid", "n", "packed").unionByName(groups.select("root", "cell", "first", "left", "right"), allowMissingColumns=True)
    found = materialise(sent.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(released(_verify(known)), "sid bigint, root bigint, links bigint"), "ngram-links")
    roots = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")), "ngram-parts")
    linked_sets = found.groupBy("sid").agg(F.sum("links").alias("links")).join(sets.select("sid", "rep"), "sid").join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    linked_sets = materialise(linked_sets, "ngram-linked")
    named = linked_sets.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked_sets = materialise(linked_sets.join(broadcast_if_small(materialise(named, "ngram-names"), 24), "root").select("sid", "class_id", "links"), "ngram-classes")
    out = sets.join(broadcast_if_small(linked_sets, 32), "sid", "left")
    return described.select("doc_id", "fp", "sid"), out.select("sid", F.coalesce("class_id", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def near_copies(docs: DataFrame, block: int = BLOCK_SETS, locally_hot: int = LOCALLY_HOT, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, class_id, n_links): every document, the least doc_id it is connected with, and how many others it is linked to."""
    members, sets = _classes(docs, block, locally_hot, frequent)
    return members.select("doc_id", "sid").distinct().join(sets, "sid").select("doc_id", "class_id", "n_links")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with only the least doc_id of each class; rows that take no part stay."""
    members, sets = _classes(docs)
    gone = members.join(sets, "sid").where("doc_id <> class_id").select(F.col("doc_id").alias("__gone"), F.col("fp").alias("__fp")).distinct()
    gone = broadcast_if_small(materialise(gone, "ngram-gone"), 32)
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__fp"]), "left_anti")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
  FROM words WHERE len(w) > 0),
sets AS MATERIALIZED (SELECT row_number() OVER () AS s, * FROM (SELECT g, min(doc_id) AS rep, count(*) AS n FROM grams GROUP BY g)),
one AS MATERIALIZED (SELECT s, len(g) AS size, unnest(g) AS gram FROM sets),
links AS MATERIALIZED (SELECT a.s AS a, b.s AS b FROM one a JOIN one b ON a.gram = b.gram AND a.s <> b.s
  GROUP BY a.s, b.s, a.size, b.size HAVING count(*) >= 0.5 * (a.size + b.size - count(*))),
reach AS (SELECT s AS a, s AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT reach.a AS s, min(rep) AS class_id FROM reach JOIN sets ON reach.b = sets.s GROUP BY reach.a),
degrees AS (SELECT links.a AS s, sum(n) AS n FROM links JOIN sets ON links.b = sets.s GROUP BY links.a)
SELECT doc_id, class_id, (sets.n - 1 + coalesce(degrees.n, 0))::BIGINT AS n_links
FROM grams JOIN sets USING (g) JOIN classes USING (s) LEFT JOIN degrees USING (s)
"""
