"""N-gram Jaccard self-join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Exact, up to collisions of 64-bit hashes, and without all-pairs work:

1. Every text becomes a sorted set of shingle hashes; equal sets collapse to one class (`set_id`).
2. Shingles found in more than `hot_df` prefixes form a Bloom filter of fixed size. It fixes a global order, cold
   shingles by hash, then hot ones. Any order that all documents share makes prefix filtering exact, so neither a
   full nor a false-positive-laden filter loses a link.
3. Two sets that link share a shingle within their prefixes. Prefix postings are dealt, packed, to tiles by ranges of
   the hash; in a tile each posting list is sorted by size and cut into bands, as sizes of linked sets differ by 1.25
   at most. Short lists give all pairs of a band, long lists only pairs with a hub per band. What one task holds of a
   very frequent shingle forms a list of its own, in one of many spare tiles, so no task gets such a list whole.
4. Pairs are checked in tiles of documents: bitmap signatures bound the overlap from above by the count of bits that
   differ, and the sorted arrays are intersected for pairs that pass, unless both are known to be connected already.
5. Long lists come back with the components found so far; only pairs between different components are still open, and
   only members stay that have another component among the sizes they can link with. Lists are cut into blocks of
   BLOCK members, anew in each round, and a block proposes the best pair between components that its signatures allow,
   fewer pairs than it has components. When a round of proposals brings little, or after ROUNDS of them, a last round
   takes every open pair: members outside a list's largest component visit all blocks of the list. It makes the result
   exact; few pairs are left for it, as those that link are in one component by then.
6. Components come from repeated contraction of the links with the smallest neighbour.

Only the first two passes hash all texts; later ones hash one text for each class that a pair needs.

Defined cases: null, empty and blank texts have an empty set and no links (component: themselves); rows that repeat an
id are judged row by row; a null id keeps its row, and takes the smallest non-null id of its component if there is one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgate.llm._shared import LOWER, STEPS, WHITE, U, WordHasher, discard, free_name, groups, hot_join, materialize, mix, reread, small_batches, text_slices, window_hashes

N = 5
#: Bits of the Bloom filter of hot shingles, and bounds of those of filters of ids, by their number.
BLOOM_BITS, MOST_BITS = 1 << 24, 1 << 27
#: At most so many shingles count as hot; the df threshold doubles until they fit.
HOT_MOST = 1 << 20
#: Postings and partitions of the first tile pass; a partition holds one tile or more, one at a time in memory.
TILE_POSTINGS, MOST_PARTITIONS = 1 << 18, 20_000
#: A tile of documents holds about so many sets, and shingles.
TILE_SETS, TILE_SHINGLES = 1500, 1 << 20
SHORT_LIST = 12
#: A task packs so many shingles at a time; more than HEAVY postings of one of them go to a spare tile.
FLUSH, HEAVY = 1 << 19, 32
BLOCK = 2048
ROUNDS = 4
SALTS = 16
#: Words of the signature of a set of up to FIRST_BAND shingles; each band of twice the size has twice as many.
SIG_WORDS, FIRST_BAND = 16, 2048
_state: dict = {}


# ---- sets


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if "hasher" not in _state:
        _state["hasher"] = WordHasher(LOWER, WHITE)
    out = []
    for a, b in groups(texts):
        words, _, _, first, _ = _state["hasher"](texts[a:b])
        grams = window_hashes(words, N)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if j - i >= N:
                g = np.sort(grams[i : j - N + 1])
                out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            elif j > i:
                short = words[i:j] * np.array(STEPS[: j - i], U)
                out.append(mix(short.sum(dtype=U, keepdims=True) + U(j - i)))
            else:
                out.append(np.empty(0, U))
    return out


def prefix_length(n: int) -> int:
    """A set of n that links with another shares one of these first elements with it."""
    return n - -(-4 * n // 5) + 1


def set_id(grams: np.ndarray) -> int:
    return int(mix(mix(grams).sum(dtype=U, keepdims=True) ^ U(len(grams)))[0].view(np.int64)) if len(grams) else 0


def bloom_slots(keys: np.ndarray, size: int):
    """Three bit positions of each key in a filter of `size` bytes, a power of two."""
    for k in (1, 2, 3):
        yield (mix(keys + STEPS[k]) >> U(64 - (8 * size).bit_length() + 1)).astype(np.int64)


def bloom_has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for s in bloom_slots(keys, len(bits)):
        out &= (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
    return out


def bloom_filter(rows: DataFrame, n: int = 0) -> np.ndarray:
    """The filter of all hashes in rows (one column of packed uint64 `keys`): partial filters of fixed size, OR-ed here.

    It has eight bits or more for each of n keys, between 2 and 16 MB; beyond that it lets more through, and loses none."""
    size = min(MOST_BITS, max(BLOOM_BITS, 1 << (8 * n).bit_length())) // 8

    def part(batches):
        bits = np.zeros(size, np.uint8)
        seen = False
        for b in batches:
            for v in b.column(0).to_pylist():
                seen = True
                for s in bloom_slots(np.frombuffer(v, U), size):
                    np.bitwise_or.at(bits, s >> 3, (1 << (s & 7)).astype(np.uint8))
        if seen:
            yield pa.RecordBatch.from_pydict({"bits": [bits.tobytes()]})

    bits = np.zeros(size, np.uint8)
    for r in rows.coalesce(8).mapInArrow(part, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    return bits


# ---- packed rows for tiles


def tile_of(keys: np.ndarray, tiles: int) -> np.ndarray:
    """Ranges of the mixed hash, as prefixes hold the smallest hashes of their sets."""
    return ((mix(keys) >> U(32)) * U(tiles) >> U(32)).astype(np.int32)


def dealt(tile: np.ndarray, keys: np.ndarray, *columns: np.ndarray):
    """One record batch with a row for each tile: sorted keys and their columns, as bytes."""
    order = np.lexsort((keys, tile))
    keys, tile = keys[order], tile[order]
    cut = np.flatnonzero(np.diff(tile, prepend=-1))
    ends = [*cut[1:].tolist(), len(keys)]
    packed = [[c[a:b].tobytes() for a, b in zip(cut.tolist(), ends)] for c in (keys, *(c[order] for c in columns))]
    names = ["tile", "keys", *(f"c{i}" for i in range(len(columns)))]
    return pa.RecordBatch.from_arrays([pa.array(tile[cut], pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names)


def unpack(pdf: pd.DataFrame, *types) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(pdf[c]), t) for c, t in zip(pdf.columns[1:], types)]


def flush_at(sets: list) -> bool:
    return sum(map(len, sets)) >= FLUSH


FIRST = "row long, doc_id long, n long, set_id long, sig binary, tile int, keys binary, counts binary"


def first_pass(tiles: int):
    """Of (row, text, doc_id). Rows of two kinds: (tile null) a document's row, id, size and class; (tile set) shingles that a flush of prefixes in hash order has twice or more, with counts."""
    names = [c.split()[0] for c in FIRST.split(", ")]

    def run(batches):
        pend: list[np.ndarray] = []

        def blocks():
            keys, n = np.unique(np.concatenate(pend), return_counts=True)
            keys, n = keys[n > 1], n[n > 1]  # the order only needs to know what is frequent
            b = dealt(tile_of(keys, tiles), keys, n.astype(np.int32))
            empty = pa.nulls(b.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(b.num_rows, pa.binary()), *b.columns], names)

        for rows, texts, ids in text_slices(batches, more=1):
            sets = shingle_sets(texts)
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array(signatures(sets), pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names
            )
            pend += [s[: prefix_length(len(s))] for s in sets if len(s)]
            if flush_at(pend):
                yield blocks()
                pend = []
        if pend:
            yield blocks()

    return run


def hot_shingles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per tile and power of two: the shingles whose count is in [2**level, 2**(level+1))."""
    keys, counts = unpack(pdf[["tile", "keys", "counts"]], U, np.int32)
    keys, inv = np.unique(keys, return_inverse=True)
    level = np.log2(np.bincount(inv, counts)).astype(int)
    rows = [(k, int((level == k).sum()), keys[level == k].tobytes()) for k in range(3, 40) if (level == k).any()]
    return pd.DataFrame(rows, columns=["level", "n", "keys"])


def postings(tiles: int, hot):
    """Prefixes in the common order: packed (shingle, set_id, size, share of hot shingles).

    What a flush holds of a heavy shingle goes to one of as many spare tiles; the shingle's own tile gets a mark (size 0),
    so that the rest of the list is long too, however short it is."""

    def run(batches):
        seen: dict[int, None] = {}
        pend: list[tuple] = []
        bits = hot.value

        def block():
            keys, ids, n, heat = (np.concatenate(x) for x in zip(*pend))
            own, at, held = np.unique(keys, return_inverse=True, return_counts=True)
            tile, heavy = tile_of(keys, tiles), held > HEAVY
            spare = tiles + (mix(own[heavy] ^ U(pend[0][1][0].view(U))) % U(tiles)).astype(np.int32)
            to = np.zeros(len(own), np.int32)
            to[heavy] = spare
            tile = np.where(heavy[at], to[at], tile)
            mark = own[heavy]
            zero = np.zeros(len(mark), np.int32)
            return dealt(np.concatenate((tile, tile_of(mark, tiles))), np.concatenate((keys, mark)), np.concatenate((ids, zero.astype(np.int64))), np.concatenate((n, zero)), np.concatenate((heat, zero.astype(np.uint8))))

        total = 0
        for _, texts in text_slices(batches):
            sets = [s for s in shingle_sets(texts) if len(s)]
            if not sets:
                continue
            known = bloom_has(bits, np.concatenate(sets))
            at = 0
            for s in sets:
                is_hot = known[at : at + len(s)]
                at += len(s)
                if (i := set_id(s)) in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen[i] = None
                p = prefix_length(len(s))
                cold = s[~is_hot][:p]
                keys = cold if len(cold) == p else np.concatenate((cold, s[is_hot][: p - len(cold)]))
                pend.append((keys, np.full(p, i, np.int64), np.full(p, len(s), np.int32), np.full(p, is_hot.mean() * 255, np.uint8)))
                total += p
            if total >= FLUSH:
                yield block()
                pend, total = [], 0
        if pend:
            yield block()

    return run


# ---- tiles of postings


def lists_of(pdf: pd.DataFrame):
    """Posting lists of two rows or more: (shingle, ids, sizes, heat), by size; a mark (size 0) comes first."""
    keys, ids, n, heat = unpack(pdf[["tile", "keys", "c0", "c1", "c2"]], U, np.int64, np.int32, np.uint8)
    order = np.lexsort((ids, n, keys))
    keys, ids, n, heat = keys[order], ids[order], n[order], heat[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, n, heat = keys[new], ids[new], n[new], heat[new]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, int)
    for a, b in zip(cut[:-1][np.diff(cut) > 1].tolist(), cut[1:][np.diff(cut) > 1].tolist()):
        yield keys[a], ids[a:b], n[a:b], heat[a:b]


def sorted_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, the smaller id first."""
    p = np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)
    return np.unique(p, axis=0) if len(p) else p


def candidate_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs (token null), and the members of long lists (b null)."""
    left, right, long = [], [], []
    spare = len(pdf) > 0 and bool(pdf["spare"].iloc[0])
    for token, ids, n, heat in lists_of(pdf):
        marked = n[0] == 0
        if marked:
            ids, n, heat = ids[1:], n[1:], heat[1:]
        if len(ids) <= SHORT_LIST and not (marked or spare):
            i, j = np.triu_indices(len(ids), 1)
            near = 4 * n[j] <= 5 * n[i]  # n rises
            left.append(ids[i[near]])
            right.append(ids[j[near]])
            continue
        band = np.floor(np.log(n) / math.log(1.25)).astype(int)
        for k in np.unique(band):  # the hub of a band: most hot shingles, so most likely the source of the copies
            own = np.flatnonzero(band == k)
            around = np.flatnonzero(np.abs(band - k) <= 1)
            hub = own[np.lexsort((ids[own], 255 - heat[own]))[0]]
            other = around[(around != hub) & (4 * np.maximum(n[around], n[hub]) <= 5 * np.minimum(n[around], n[hub]))]
            left.append(ids[other])
            right.append(np.full(len(other), ids[hub]))
        long.append((np.full(len(ids), token, U).view(np.int64), ids, n))
    pairs = sorted_pairs(np.concatenate(left), np.concatenate(right)) if left else np.empty((0, 2), np.int64)
    token, a, n = (np.concatenate(x) for x in zip(*long)) if long else (np.empty(0, np.int64),) * 3
    p, m = len(pairs), len(a)
    b = pd.array(np.concatenate((pairs[:, 1], np.zeros(m, np.int64))), "Int64")
    t = pd.array(np.concatenate((np.zeros(p, np.int64), token)), "Int64")
    b[p:], t[:p] = pd.NA, pd.NA
    return pd.DataFrame({"a": np.concatenate((pairs[:, 0], a)), "b": b, "token": t, "n": np.concatenate((np.zeros(p, np.int32), n)).astype(np.int32)})


def open_pairs(every: bool):
    """Of some blocks of long lists: pairs of near size in different components whose signatures allow a link.

    Every such pair of a visitor and a member at home; or, where all are at home, the likeliest pairs until those of
    the tile would connect all components that can be: fewer pairs than components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, pdf["c"] = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        root = np.arange(len(names))
        found, done = [np.empty((0, 2), np.int64)], set()
        for _, g in pdf.groupby(["token", "block"], sort=False):
            home = g[g["home"]].sort_values(["n", "a"])
            if g["c"].nunique() < 2 or not len(home):
                continue
            a, n, c = (home[x].to_numpy() for x in ("a", "n", "c"))
            if every:
                go = g[~g["home"]].sort_values(["n", "a"])
            else:
                go = home[home["c"] != home["c"].value_counts().index[0]]
            if (same := hash((a.tobytes(), go["a"].to_numpy().tobytes()))) in done:
                continue
            done.add(same)
            bits, here = Signatures([*home["sig"], *go["sig"]]), len(a)
            low, high = (np.searchsorted(n, x, side=side) for x, side in ((-(-4 * go["n"].to_numpy() // 5), "left"), (go["n"].to_numpy() * 5 // 4, "right")))
            for k, (v, vn, vc) in enumerate(zip(go["a"].tolist(), go["n"].tolist(), go["c"].tolist())):
                at = slice(low[k], high[k])
                at = low[k] + np.flatnonzero(c[at] != vc if every else root[c[at]] != root[vc])
                if not len(at):
                    continue
                total = n[at].astype(np.int64) + vn
                most = (total - bits.differ(np.full(len(at), here + k), at)) // 2
                near = 100 * most >= 80 * (total - most)
                at = at[near]
                if not every and len(at):  # the likeliest member of each component
                    at = at[np.argsort(-most[near] / total[near], kind="stable")]
                    at = at[np.sort(np.unique(root[c[at]], return_index=True)[1])]
                    root[np.isin(root, root[c[at]])] = root[vc]
                if len(at):
                    found.append(np.stack((np.minimum(a[at], v), np.maximum(a[at], v)), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


# ---- exact check


def sig_band(n: int) -> int:
    return max(0, (max(n, 1) - 1).bit_length() - FIRST_BAND.bit_length() + 1)


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """A bitmap of each set, by its size band: each shingle flips the bit of its hash's top bits.

    Shared shingles flip the same bits in both bitmaps, so no more bits differ than shingles do; unlike bits that are
    only set, flipped ones still differ where a set has more shingles than the bitmap has bits."""
    out = [b""] * len(sets)
    for band in {sig_band(len(s)) for s in sets}:
        own = [k for k, s in enumerate(sets) if sig_band(len(s)) == band]
        width = SIG_WORDS * 64 << band
        row = np.repeat(np.arange(len(own)), [len(sets[k]) for k in own])
        bit = (np.concatenate([sets[k] for k in own]) >> U(64 - int(math.log2(width)))).astype(np.int64)
        odd = np.bincount(row * width + bit, minlength=len(own) * width) & 1
        for k, bits in zip(own, np.packbits(odd.astype(bool).reshape(len(own), width), axis=1)):
            out[k] = bits.tobytes()
    return out


class Signatures:
    """Bitmaps of some sets, also folded to the widths of the smaller bands: neighbouring bits, XOR-ed, are the next smaller bitmap."""

    def __init__(self, sigs):
        self.band = np.array([(len(s) // (8 * SIG_WORDS)).bit_length() - 1 for s in sigs], int)
        self.at: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        carry, own = None, np.empty(0, int)
        for band in range(int(self.band.max(initial=0)), -1, -1):
            here = np.flatnonzero(self.band == band)
            fresh = np.frombuffer(b"".join(sigs[k] for k in here.tolist()), np.uint8).reshape(len(here), 8 * SIG_WORDS << band)
            if carry is not None and len(own):
                x = np.unpackbits(carry, axis=1)
                fresh = np.concatenate((np.packbits(x[:, ::2] ^ x[:, 1::2], axis=1), fresh))
                here = np.concatenate((own, here))
            carry, own = fresh, here
            place = np.full(len(self.band), -1)
            place[here] = np.arange(len(here))
            self.at.insert(0, place)
            self.bits.insert(0, np.ascontiguousarray(fresh).view(U))

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bits at least differ between sets x and y (indexes), by the widest bitmap that both have."""
        out = np.empty(len(x), np.int64)
        common = np.minimum(self.band[x], self.band[y])
        for band in np.unique(common).tolist():
            k = np.flatnonzero(common == band)
            bits, at = self.bits[band], self.at[band]
            out[k] = np.bitwise_count(bits[at[x[k]]] ^ bits[at[y[k]]]).sum(axis=1, dtype=np.int64)
        return out


def near_pairs(key, sigs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a tile whose overlap can reach the threshold by the bit counts of their signatures."""
    sigs = sigs.sort_values("set_id")
    ids, size = sigs["set_id"].to_numpy(), sigs["n"].to_numpy()
    bits = Signatures(sigs["sig"].tolist())
    a, b = np.searchsorted(ids, pairs["a"].to_numpy()), np.searchsorted(ids, pairs["b"].to_numpy())
    keep = [np.empty(0, np.int64)]
    for at in range(0, len(a), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        total = size[x] + size[y]
        most = (total - bits.differ(x, y)) // 2  # the overlap is at most this
        keep.append(at + np.flatnonzero(100 * most >= 80 * (total - most)))
    return pairs.iloc[np.concatenate(keep)]


def linked_pairs(key, sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a tile that link, by intersection of the sorted arrays; but those that others of the tile already imply."""
    sets = sets.drop_duplicates("set_id").sort_values("set_id")
    ids = sets["set_id"].to_numpy()
    grams = [np.frombuffer(g, U) for g in sets["grams"]]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for x, y in zip(np.searchsorted(ids, pairs["a"].to_numpy()).tolist(), np.searchsorted(ids, pairs["b"].to_numpy()).tolist()):
        rx, ry = find(x), find(y)
        if rx == ry:
            continue
        s, t = (grams[x], grams[y]) if len(grams[x]) <= len(grams[y]) else (grams[y], grams[x])
        at = np.searchsorted(t, s)
        at[at == len(t)] = 0
        both = int(np.count_nonzero(t[at] == s))
        if 100 * both >= 80 * (len(s) + len(t) - both):
            root[rx] = ry
            links.append((ids[x], ids[y]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def tiled(pairs: DataFrame, cls: DataFrame) -> DataFrame:
    """(tile, a, b): pairs of one neighbourhood share a tile; neighbourhoods of more than TILE_SETS classes, or TILE_SHINGLES
    shingles, are cut into blocks. A class thus goes to few tiles, however many pairs it has, and no tile outgrows a few blocks."""
    ends = pairs.select("a", "b").union(pairs.select("b", "a"))
    node = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    node = materialize(node.join(cls.select(F.col("set_id").alias("a"), "n"), "a"), few=True)
    sized = materialize(node.groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("w")), few=True)
    cut = F.ceil(F.greatest(F.col("k") / TILE_SETS, F.col("w") / TILE_SHINGLES))
    cell = materialize(hot_join(node, sized, "label", "k").select(F.col("a").alias("id"), F.xxhash64("label", F.pmod(F.xxhash64("a"), cut)).alias("cell"), "n"), few=True)
    held = cell.agg(F.count("*"), F.sum("n")).first()
    tiles = max(1, math.ceil(2 * held[0] / TILE_SETS), math.ceil(2 * (held[1] or 0) / TILE_SHINGLES))
    x, y = cell.select(F.col("id").alias("a"), F.col("cell").alias("x")), cell.select(F.col("id").alias("b"), F.col("cell").alias("y"))
    out = materialize(pairs.join(x, "a").join(y, "b").select(F.pmod(F.xxhash64("x", "y"), F.lit(tiles)).alias("tile"), "a", "b"), few=True)
    discard(node, sized, cell)
    return out


def needed(placed: DataFrame) -> DataFrame:
    return placed.select("tile", F.col("a").alias("set_id")).union(placed.select("tile", "b")).distinct()


def link_pairs(docs: DataFrame, cls: DataFrame, pairs: DataFrame, bounded: bool = False) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that link, exactly; enough of them to connect what is connected.

    `bounded` pairs have passed the signatures already. Of docs (row, text) only the texts that cls names are hashed."""
    placed = near = tiled(pairs, cls)
    if not bounded:
        at = cls.select("set_id", "n", "sig").join(needed(placed), "set_id").groupBy("tile")
        near = materialize(at.cogroup(reread(placed).groupBy("tile")).applyInPandas(near_pairs, "tile long, a long, b long"), few=True)
    where = materialize(needed(near).groupBy("set_id").agg(F.collect_list("tile").alias("tiles")).join(cls.select("set_id", "row"), "set_id"), few=True)
    bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(packed_ids(where.select("row")), where.count()))

    def sets(batches):
        seen: set[int] = set()
        for rows, texts in text_slices(batches):
            keep = np.flatnonzero(bloom_has(bits.value, np.array(rows, np.int64).view(U))).tolist()
            keep = [k for k in keep if not (rows[k] in seen or seen.add(rows[k]))]
            if len(seen) > 1 << 20:
                seen.clear()
            for x, y in groups([texts[k] for k in keep], 1 << 21):
                found = [s for s in shingle_sets([texts[k] for k in keep[x:y]]) if len(s)]
                if found:
                    yield pa.RecordBatch.from_pydict({"set_id": pa.array([set_id(s) for s in found], pa.int64()), "grams": pa.array([s.tobytes() for s in found], pa.binary())})

    grams = docs.mapInArrow(sets, "set_id long, grams binary").join(where.drop("row"), "set_id").select(F.explode("tiles").alias("tile"), "set_id", "grams")
    links = materialize(grams.groupBy("tile").cogroup(reread(near).groupBy("tile")).applyInPandas(linked_pairs, "a long, b long"), few=True)
    bits.unpersist()
    discard(placed, near, where)
    return links


def packed_ids(ids: DataFrame) -> DataFrame:
    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"keys": pa.array([b.column(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary())})

    return ids.mapInArrow(pack, "keys binary")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id connected with each id of links, by contraction with the smallest neighbour."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), few=True)
    label = None
    while True:
        up = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), few=True)
        if label is None:
            new = up.select(F.col("a").alias("id"), F.col("up").alias("comp"))
        else:
            new = label.join(up, label["comp"] == up["a"], "left").select("id", F.coalesce("up", "comp").alias("comp"))
        new = materialize(new, few=True)
        to = up.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        left = materialize(edges.join(up, "a").join(to, "b").filter("up <> ub").select(F.col("up").alias("a"), F.col("ub").alias("b")).distinct(), few=True)
        discard(edges, up, *([label] if label is not None else []))
        edges, label = left, new
        if edges.isEmpty():
            discard(edges)
            return label


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only their edges between components are contracted."""
    alone = links.select("a").union(links.select("b")).distinct().join(comp, F.col("a") == F.col("id"), "left_anti").select(F.col("a").alias("id"), F.col("a").alias("comp"))
    every = materialize(comp.union(alone), few=True)
    x, y = reread(every).select(F.col("id").alias("a"), F.col("comp").alias("x")), reread(every).select(F.col("id").alias("b"), F.col("comp").alias("y"))
    up = components(links.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = materialize(every.join(up.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), few=True)
    discard(every, up, comp, links)
    return out


def still_open(long: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (token, a, n) of long lists with their component, where their size band or a neighbouring one holds another
    component; with the list's length k in blocks and its largest component, `major`."""
    long = long.join(comp.select(F.col("id").alias("a"), "comp"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    long = materialize(long.withColumn("band", F.floor(F.log("n") / math.log(1.26))), few=True)  # sizes of linked sets are at most one band apart
    spans = long.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    spans = spans.select("token", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "lo", "hi")
    mixed = spans.groupBy("token", "band").agg((F.min("lo") < F.max("hi")).alias("mixed")).filter("mixed").select("token", "band")
    held = long.groupBy("token", "comp").count().groupBy("token").agg(F.max_by("comp", "count").alias("major"), F.ceil(F.sum("count") / BLOCK).cast("int").alias("k"))
    mixed = mixed.join(held, "token").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = materialize(long.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(mixed, ["token", "band", "salt"]).select("token", "a", "n", "comp", "major", "k"), few=True)
    discard(long)
    return out


def proposals(members: DataFrame, cls: DataFrame, tiles: int, turn: int, every: bool) -> DataFrame:
    """Distinct pairs (a, b) of open members: in the last round all that can link, before that some of each block."""
    at_home = members.withColumn("block", F.pmod(F.xxhash64("a", F.lit(turn)), F.col("k")).cast("int")).withColumn("home", F.lit(True))
    if every:
        visit = members.filter("comp <> major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("home", F.lit(False))
        at_home = at_home.unionByName(visit)
    rows = at_home.drop("k", "major").join(cls.select(F.col("set_id").alias("a"), "sig"), "a")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("token", "block"), F.lit(4 * tiles)))
    return materialize(rows.groupBy("tile").applyInPandas(open_pairs(every), "a long, b long").distinct(), few=True)


def row_classes(docs: DataFrame, hot_df: int = 8) -> tuple[DataFrame, DataFrame]:
    """Of docs (row, text, doc_id), row being a hash of the row: the table (row, doc_id, n, set_id) of all rows, and that of
    classes (set_id, copies, component, component_row), with the smallest id (nulls last) and its row in the component."""
    spark = small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tiles = max(1, math.ceil(size / 6 / 5 / TILE_POSTINGS))  # of about six bytes a word, a fifth is in the prefix
    parts = min(MOST_PARTITIONS, max(tiles, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    texts = docs.select("row", "text")
    first = materialize(docs.select("row", "text", "doc_id").mapInArrow(first_pass(tiles), FIRST))
    member = first.filter("tile IS NULL").select("row", "doc_id", "n", "set_id")
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("row"))).alias("least")
    cls = materialize(first.filter("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"), least).select("set_id", "n", "sig", "copies", "least", "least.row"))

    hot = materialize(first.filter("tile IS NOT NULL").select("tile", "keys", "counts").repartition(parts, "tile").groupBy("tile").applyInPandas(hot_shingles, "level int, n long, keys binary"), few=True)
    level = int(math.log2(hot_df))
    held = {r["level"]: r["n"] for r in hot.groupBy("level").agg(F.sum("n").alias("n")).collect()}  # at most 40 rows
    while sum(n for k, n in held.items() if k >= level) > HOT_MOST:
        level += 1
    filter_ = spark.sparkContext.broadcast(bloom_filter(hot.filter(F.col("level") >= level).select("keys")))
    posted = texts.mapInArrow(postings(tiles, filter_), "tile int, keys binary, c0 binary, c1 binary, c2 binary").withColumn("spare", F.col("tile") >= tiles)
    found = materialize(posted.repartition(parts, "tile").groupBy("tile").applyInPandas(candidate_rows, "a long, b long, token long, n int"), few=True)
    pairs = materialize(found.filter("token IS NULL").select("a", "b").distinct(), few=True)
    comp = components(link_pairs(texts, cls, pairs))
    discard(hot, pairs)

    long = found.filter("token IS NOT NULL").select("token", "a", "n")
    turn, last = 0, False
    while not last:
        members = still_open(long, comp)
        last = turn == ROUNDS
        open_ = proposals(members, cls, tiles, turn, last)
        if not last and open_.isEmpty():  # of blocks of their own; the last round lets all blocks meet
            discard(open_)
            last = True
            open_ = proposals(members, cls, tiles, turn, last)
        if not open_.isEmpty():
            links = link_pairs(texts, cls, open_, bounded=True)
            brought = links.count()
            if brought:
                comp = joined(comp, links)
            turn = ROUNDS if 16 * brought < open_.count() else turn + 1
        discard(members, open_)
    discard(found)

    label = materialize(cls.drop("sig").join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id")), few=True)
    own = materialize(label.groupBy("comp").agg(F.count("*").alias("k"), F.min("least").alias("best")), few=True)
    classes = materialize(hot_join(label, own, "comp", "k").select("set_id", "copies", F.col("best.doc_id").alias("component"), F.col("best.row").alias("component_row")), few=True)
    discard(comp, label, own, cls)
    return member, classes


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_df: int = 8) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    member, classes = row_classes(docs.withColumn("row", F.xxhash64("doc_id", "text")), hot_df)
    some = hot_join(member.filter("n > 0"), classes, "set_id", "copies").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return some.union(member.filter("n = 0").select("doc_id", "n", "doc_id"))


def parted(docs: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose key is not among rows (one column), and those for which it may be, by a Bloom filter.

    Only the latter, some false hits among them, need a join with rows; the texts of all others stay where they are."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(packed_ids(rows), rows.count()))

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(bloom_has(bits.value, keys.to_numpy(np.int64).view(U)))

    found = hit(F.col(key))
    return docs.filter(~found), docs.filter(found)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that of the smallest id, nulls last, and of rows that share the id the one with
    the smallest hash over all columns (map columns aside). Rows with an empty set all stay. Rows are told apart by that
    hash, so an id that repeats with other texts loses none of them, and copies with a null id go."""
    key = free_name(docs, "row")
    flat = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumn(key, F.xxhash64(*flat))
    member, classes = row_classes(marked.select(F.col(key).alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id")))
    found = materialize(hot_join(member.filter("n > 0"), classes, "set_id", "copies").select("row", (F.col("row") == F.col("component_row")).alias("stays")), few=True)
    drop = materialize(found.filter(~F.col("stays")).select(F.col("row").alias(key)).distinct(), few=True)
    again = materialize(found.filter("stays").groupBy("row").count().filter("count > 1").select(F.col("row").alias(key)), few=True)
    discard(member, classes, found)
    clear, maybe = parted(marked, drop.union(again), key)
    maybe = maybe.join(drop, key, "left_anti")
    once = maybe.join(again, key, "left_anti").unionByName(maybe.join(reread(again), key, "left_semi").dropDuplicates([key]))
    return clear.unionByName(once).drop(key)
