"""Benchmark decontamination by template windows.

Texts become words without punctuation, in lower case. In the template stream numbers, capitalised names inside a
sentence, and units behind a number are typed placeholders. Windows of 8 words of the benchmark, literal and template,
are hashed into a table; windows of the documents are looked up in it. A template window counts only if most of its
words are literal and if, along its alignment with the item, each slot value of the item always meets the same value of
the document. So an item with other numbers or names is found, and a text that merely has the same shape is not.
Capitalised words at the start of a sentence may be names or not: a third, wide stream takes them as names too. Where
such a word is the same on both sides it counts as literal. Windows in which one side has such a word lower-case, while
another sentence-initial word differs, match in no stream.

A document holds an item when consistent windows cover half of the item's, or a run of 20 words. A benchmark of up to
BROADCAST_ITEMS items and BROADCAST_BYTES of text is checked in one pass over the documents, by a table that is
broadcast. A larger one is hash-joined: windows of documents that a Bloom filter lets through meet the windows of the
items, and only the (document, item) pairs that share one are checked, by the same rule.

Defined cases: null and empty texts hold nothing; items below 4 words are ignored, items of 4 to 7 words must occur
whole, literally or with other slot values if over half of the words are the same; repeated items are each reported; a
null item text is ignored; repeated documents are each judged; an empty benchmark or table gives an empty result; texts
of any length are read whole. Of slot values that are equally frequent the larger hash is taken. Columns with clashing
names pass through clean() as they are.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgate.llm._shared import LOWER, U, WordHasher, free_name, groups, materialize, reread, small_batches, text_slices, window_hashes
from memgate.llm.ngram_join import bloom_filter, bloom_has, packed_ids, parted

SIZE = 8
LEAST_WORDS = 4
LEAST_LITERAL = 5
SHARE, RUN = 0.5, 20
BROADCAST_ITEMS, BROADCAST_BYTES = 20_000, 1 << 20
SALTS = 16
ALNUM = np.array([chr(c).isalnum() and c < 128 or c >= 128 for c in range(256)])
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
UPPER = np.array([chr(c).isupper() for c in range(1 << 16)])
POINT = np.isin(np.arange(256), list(b".,"))
STOP = np.isin(np.arange(256), list(b".!?:\n"))
NUMBER, NAME, UNIT = U(0x6E756D), U(0x6E616D65), U(0x756E6974)
#: Words that count as units behind a number.
UNITS = "mm cm m km in ft yd mi mile miles meter meters metre metres mg g kg lb lbs oz ton tons ml l liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur c f k".split()
_state: dict = {}


class Hasher(WordHasher):
    """Words are runs of letters and digits; a point or comma between digits belongs to the number."""

    def __call__(self, texts):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        glue = np.zeros(len(raw), bool)
        digit = DIGIT[raw]
        glue[1:-1] = POINT[raw[1:-1]] & digit[:-2] & digit[2:]
        if not glue.any():
            return super().__call__(texts)
        # glued points become a byte that no UTF-8 text holds
        joined = np.where(glue, np.uint8(0xFF), raw).tobytes()
        cut = np.cumsum([0] + [len(t) + 1 for t in texts])
        return super().__call__([joined[a : b - 1] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])


def hasher() -> Hasher:
    if "hasher" not in _state:
        _state["hasher"] = h = Hasher(LOWER, ~ALNUM)
        _state["units"] = np.sort(h([u.encode() for u in UNITS])[0])
    return _state["hasher"]


def letters(data: np.ndarray, at: np.ndarray):
    """Code points (of the first plane) of the UTF-8 characters that begin at these bytes, and their lengths."""
    b = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(3)]
    size = 1 + (b[0] >= 0xC0) + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    two, three = (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
    return np.select([size == 1, size == 2, size == 3], [b[0], two, three], 0), size


def streams(texts: list[bytes]):
    """Literal words, template words, wide template words, and the first word of each text (closed by the count)."""
    words, start, end, first, data = hasher()(texts)
    template, wide = words.copy(), words.copy()
    if len(words):
        number = DIGIT[data[start]]
        stops = np.cumsum(STOP[data])
        after = np.ones(len(words), bool)  # at the start of a sentence
        after[1:] = stops[start[1:]] > stops[end[:-1] - 1]
        letter, size = letters(data, start)
        capital = UPPER[letter] & ~UPPER[letters(data, start + size)[0]] & (end - start > size)
        name = capital & ~after
        unit = np.zeros(len(words), bool)
        unit[1:] = number[:-1] & ~number[1:]
        at = np.flatnonzero(unit)
        units = _state["units"]
        unit[at] = units[np.minimum(np.searchsorted(units, words[at]), len(units) - 1)] == words[at]
        template[number], template[name], template[unit] = NUMBER, NAME, UNIT
        wide = np.where(capital & after & (template == words), NAME, template)
    return words, template, wide, first


def table_of(items: list[tuple[int, bytes]]) -> dict:
    """Window hashes of the items, sorted, with item and position; the items' words and numbers of windows."""
    ids, words, templates, wides, short, rows = [], [], [], [], defaultdict(set), []
    for i, t in items:
        w, v, x, _ = streams([t])
        if len(w) < LEAST_WORDS:
            continue
        k = len(ids)
        ids.append(i)
        words.append(w)
        templates.append(v)
        wides.append(x)
        if len(w) < SIZE:
            short[len(w)].add((int(window_hashes(w, len(w))[0]), k))
            if 2 * np.count_nonzero(v != w) < len(w):
                short[len(w)] |= {(int(window_hashes(stream, len(w))[0]), k) for stream in (v, x)}
            continue
        literal, shaped = window_hashes(w, SIZE), window_hashes(v, SIZE)
        slots = np.convolve(v != w, np.ones(SIZE, int))[SIZE - 1 : len(w)]
        rows += [(h, k, p, 0) for p, h in enumerate(literal)]
        rows += [(h, k, p, 0) for p, h in enumerate(shaped) if 0 < slots[p] <= SIZE - LEAST_LITERAL]
        rows += [(h, k, p, 1) for p, h in enumerate(window_hashes(x, SIZE)) if h != shaped[p] and slots[p] <= SIZE - LEAST_LITERAL]
    rows.sort()
    keys = np.array([r[0] for r in rows], U)
    seen = np.zeros(1 << 20, bool)
    seen[keys >> U(44)] = True
    short = {size: (np.array([h for h, _ in own], U), [k for _, k in own]) for size, own in ((size, sorted(own)) for size, own in short.items())}
    columns = {name: np.array([r[c] for r in rows], np.int64) for c, name in ((1, "item"), (2, "pos"), (3, "wide"))}
    return {"ids": ids, "words": words, "templates": templates, "wides": wides, "short": short, "keys": keys, "seen": seen} | columns


def looked_up(hashes: np.ndarray, table: dict):
    """Pairs (index of a hash, row of the table) that are equal."""
    keys = table["keys"]
    at = np.flatnonzero(table["seen"][hashes >> U(44)])
    lo, hi = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
    n = hi - lo
    return np.repeat(at, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def consistent(hits: list[tuple[int, int]], words: np.ndarray, template: np.ndarray, item_words: np.ndarray, item_template: np.ndarray, size: int = SIZE) -> set[int]:
    """Of hits (position in the document, in the item): item positions of windows of size words whose slots agree along their alignment."""
    by = defaultdict(list)
    for d, p in hits:
        by[d - p].append((d, p))
    kept: set[int] = set()
    for own in by.values():
        votes: dict[int, Counter] = defaultdict(Counter)
        slots = {}
        for d, p in own:
            differ = np.flatnonzero((words[d : d + size] != item_words[p : p + size]) | (template[d : d + size] != words[d : d + size]) & (item_template[p : p + size] != item_words[p : p + size]))
            slots[d, p] = [(int(item_words[p + k]), int(words[d + k])) for k in differ.tolist()]
        for a, b in {(p + k, x) for (_, p), s in slots.items() for k, x in enumerate(s)}:
            votes[b[0]][b[1]] += 1
        chosen = {v: max(c.items(), key=lambda x: (x[1], x[0]))[0] for v, c in votes.items()}
        kept |= {p for (_, p), s in slots.items() if all(chosen[v] == x for v, x in s)}
    return kept


def mostly_literal(d: int, p: int, words: np.ndarray, item_words: np.ndarray, item_template: np.ndarray, size: int, most: int) -> bool:
    """Whether a window is literal, or has at most so many slots; a sentence-initial word that is the same counts as literal."""
    differ = words[d : d + size] != item_words[p : p + size]
    return not differ.any() or np.count_nonzero(differ | (item_template[p : p + size] != item_words[p : p + size])) <= most


def longest_run(positions: set[int]) -> int:
    best = run = 0
    last = -2
    for p in sorted(positions):
        run = run + 1 if p == last + 1 else 1
        best, last = max(best, run), p
    return best


def held_items(texts: list[bytes], table: dict):
    """(index of the text, item's index, windows found, item's windows) for each text that holds an item."""
    for a, b in groups(texts):
        words, template, wide, first = streams(texts[a:b])
        if len(words) < LEAST_WORDS:
            continue
        hits: dict[tuple[int, int], set] = defaultdict(set)
        wider: dict[tuple[int, int], set] = defaultdict(set)  # hits that take sentence-initial words as names on either side
        if len(table["keys"]):
            for stream in (words, template, wide):
                at, row = looked_up(window_hashes(stream, SIZE), table)
                doc = np.searchsorted(first, at, side="right") - 1
                inside = at + SIZE <= first[doc + 1] if len(at) else at.astype(bool)
                for d, x, r in zip(doc[inside].tolist(), at[inside].tolist(), row[inside].tolist()):
                    (wider if stream is wide or table["wide"][r] else hits)[d, int(table["item"][r])].add((x, int(table["pos"][r])))
        for d, k in sorted(hits.keys() | wider.keys()):
            item, shape, wide_shape = table["words"][k], table["templates"][k], table["wides"][k]
            n = len(item) - SIZE + 1
            plain = hits.get((d, k), set())
            more = {(x, p) for x, p in wider.get((d, k), set()) - plain if mostly_literal(x, p, words, item, shape, SIZE, SIZE - LEAST_LITERAL)}
            tries = [consistent(sorted(plain), words, template, item, shape)]
            if more:
                tries.append(consistent(sorted(plain | more), words, wide, item, wide_shape))
            held = [len(kept) for kept in tries if kept and (len(kept) >= SHARE * n or longest_run(kept) + SIZE - 1 >= RUN)]
            if held:
                yield a + d, k, max(held), n
        for size, (keys, items) in table["short"].items():
            found = set()
            for stream in (words, template, wide):
                h = window_hashes(stream, size)
                at = np.flatnonzero(np.isin(h, keys))
                doc = np.searchsorted(first, at, side="right") - 1
                inside = at + size <= first[doc + 1] if len(at) else at.astype(bool)
                for d, x in zip(doc[inside].tolist(), at[inside].tolist()):
                    for r in range(np.searchsorted(keys, h[x], "left"), np.searchsorted(keys, h[x], "right")):
                        k = items[r]
                        item, shape = table["words"][k], table["templates"][k]
                        literal = np.array_equal(words[x : x + size], item)
                        if literal or (d, k) not in found and mostly_literal(x, 0, words, item, shape, size, (size - 1) // 2) and consistent([(x, 0)], words, wide, item, table["wides"][k], size):
                            found.add((d, k))
            for d, k in sorted(found):
                yield a + d, k, 1, 1


def small_table(benchmark: DataFrame, item_col: str, text_col: str, most_items: int, most_bytes: int):
    """The broadcast table of a benchmark within the bounds, else None."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(item_col), F.col(text_col))
    held = items.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    if held[0] > most_items or (held[1] or 0) > most_bytes:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(table_of([(r[0], r[1].encode()) for r in items.collect()]))


def item_windows(batches):
    """(h, item) of every window by which an item can be found."""
    for keys, texts in text_slices(batches):
        for k, text in zip(keys, texts):
            table = table_of([(k, text)])
            h = np.unique(np.concatenate([table["keys"], *(own for own, _ in table["short"].values())]).astype(U))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), k, np.int64))], ["h", "item"])


def joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, n_found, n_windows) for docs (row, text, doc_id) and items (item, text, item_id), by a hash join of windows."""
    own = materialize(items.select("item", "text").distinct().mapInArrow(item_windows, "h long, item long"))
    bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(packed_ids(own.select("h")), own.count()))

    def windows(batches):
        for rows, texts in text_slices(batches):
            at, got = [np.empty(0, np.int64)], [np.empty(0, U)]
            for a, b in groups(texts):
                *kinds, first = streams(texts[a:b])
                for stream in kinds:
                    for size in range(LEAST_WORDS, SIZE + 1):
                        h = window_hashes(stream, size)
                        k = np.flatnonzero(bloom_has(bits.value, h)) if len(h) else np.empty(0, int)
                        doc = np.searchsorted(first, k, side="right") - 1
                        inside = k + size <= first[doc + 1] if len(k) else k.astype(bool)
                        at.append(np.array(rows, np.int64)[a + doc[inside]])
                        got.append(h[k[inside]])
            pairs = np.unique(np.stack((np.concatenate(at), np.concatenate(got).view(np.int64)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["row", "h"])

    # a window that many documents hold is dealt to SALTS tasks
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = docs.select("row", "text").mapInArrow(windows, "row long, h long").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    pairs = materialize(found.join(own.withColumn("salt", salt), ["h", "salt"]).select("row", "item").distinct(), few=True)
    wide = docs.join(pairs, "row").join(items.select("item", F.col("text").alias("item_text"), "item_id"), "item")
    wide = wide.select("item", "row", "doc_id", "item_id", "text", "item_text").sortWithinPartitions("item")

    def check(batches):
        key, table = None, None
        for b in batches:
            out = []
            texts, item_texts = (b.column(c).cast(pa.binary()).to_pylist() for c in (4, 5))
            for k, row, doc, item, text, item_text in zip(*(b.column(c).to_pylist() for c in range(4)), texts, item_texts):
                if key != k:
                    key, table = k, table_of([(k, item_text)])
                out += [(row, doc, item, n, m) for _, _, n, m in held_items([text], table)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], ["row", "doc_id", "item_id", "n_found", "n_windows"])

    return wide.mapInArrow(check, "row long, doc_id long, item_id long, n_found long, n_windows long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(id_col, text_col).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"))


def items_of(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    own = benchmark.filter(F.col(item_text).isNotNull())
    return own.select(F.xxhash64(item_text).alias("item"), F.col(item_text).alias("text"), F.col(item_col).cast("long").alias("item_id"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_items: int = BROADCAST_ITEMS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row (doc_id, item_id, n_found, n_windows) for each item that a document holds."""
    small_batches(docs.sparkSession)
    shared = small_table(benchmark, item_col, item_text, most_items, most_bytes)
    if shared is None:
        return joined(keyed(docs, id_col, text_col), items_of(benchmark, item_col, item_text)).drop("row")

    def run(batches):
        table = shared.value
        for ids, texts in text_slices(batches):
            found = [(ids[d], table["ids"][k], n, m) for d, k, n, m in held_items(texts, table)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["doc_id", "item_id", "n_found", "n_windows"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, item_id long, n_found long, n_windows long")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_items: int = BROADCAST_ITEMS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without those that hold an item, all columns as they were. Texts move only where a benchmark beyond the bounds has
    a candidate for them."""
    small_batches(docs.sparkSession)
    shared = small_table(benchmark, item_col, item_text, most_items, most_bytes)
    if shared is None:
        key = free_name(docs, "row")
        marked = docs.withColumn(key, F.xxhash64(text_col))
        rows = marked.select(F.col(key).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"), F.lit(0).cast("long").alias("doc_id"))
        drop = materialize(joined(rows, items_of(benchmark, item_col, item_text)).select(F.col("row").alias(key)).distinct(), few=True)
        clear, maybe = parted(marked, drop, key)
        return clear.unionByName(maybe.join(reread(drop), key, "left_anti")).drop(key)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()
            keep = np.ones(len(texts), bool)
            for d, *_ in held_items(texts, shared.value):
                keep[d] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
