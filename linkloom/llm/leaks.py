"""Documents that hold passages of held-out evaluation items.

Every shard of the corpus becomes an FM-index over word codes; the short phrases of all items are
found by backward search, located by sampled suffix positions, and joined to passages. Parts with
words lost or put in are counted wherever enough of their words stand near each other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import spread

#: Words of a verbatim passage, share of a whole part (as a fraction), and words of the phrases looked up.
RUN_WORDS, WHOLE_SHARE, SEED = 12, (4, 5), 4
#: A stretch of a document may be longer than the part by this factor.
STRETCH = 1.5
#: Words of documents in one index; items that are looked up together, and their bytes.
SHARD_WORDS, ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 2_000_000, 20_000, 32_000_000
#: Parts of like length whose words are counted together, and rows of words summed at once.
_GROUP, _ROWS = 512, 100_000

# In order: what is looked for and what it becomes.
_MARKUP = [
    (r"</?(?:b|i|u|s|em|strong|code|span|mark|tt|sub|sup|a|small|kbd)(?:\s[^<>]*)?>", ""),
    (r"<[/!]?[a-zA-Z][^<>]{0,300}>", " "),
    (r"(?i)&(?:apos|rsquo|lsquo|shy|#39|#x27|#8217);", ""),
    (r"&#?[A-Za-z0-9]{1,8};|\\[nrt]", " "),
    ("[_'’‘ʼ`´*~\\\\\u00ad\u200b-\u200f\u2060\ufeff]+", ""),
    (r"([\p{L}\p{N}])[-‐‑](?:\r?\n[ \t>#/*|]*)?([\p{L}\p{N}])", r"\1\2"),
]
_NUMBERED = r"(?m)^[ \t]*\d+ ?[:|][ \t]+"


def words_of(texts: pa.Array) -> pa.ListArray:
    """Words without case, punctuation, layout and markup; hyphens and marks inside a word vanish.
    The pattern engine of Arrow runs in linear time, whatever the text."""
    wide = pc.match_substring_regex(texts, "[！-～ﬀ-ﬆ]")
    if pc.any(wide).as_py():
        texts = pc.if_else(wide, pc.utf8_normalize(texts, form="NFKC"), texts)
    # lines of a listing, if at least two are numbered
    listing = pc.greater_equal(pc.count_substring_regex(texts, _NUMBERED), 2)
    if pc.any(listing).as_py():
        texts = pc.if_else(listing, pc.replace_substring_regex(texts, _NUMBERED, ""), texts)
    for pattern, instead in _MARKUP:
        texts = pc.replace_substring_regex(texts, pattern, instead)
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+")
    # a text that begins or ends with a gap has an empty word there
    words = lists.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(full)))


class _Phrases:
    """The items of a block as word codes, and all phrases of SEED words of those that can hold a passage."""

    def __init__(self, parts: list[tuple[int, list[str]]]):
        words = sorted({w for _, p in parts for w in p})
        self.words = pa.array(words, pa.string())
        code = {w: i + 1 for i, w in enumerate(words)}
        self.items = [i for i, _ in parts]
        self.parts = [np.array([code[w] for w in p], np.int64) for _, p in parts]
        found: dict[tuple, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.parts):
            for i in range(len(p) - SEED + 1) if len(p) >= RUN_WORDS else ():
                found.setdefault(tuple(p[i : i + SEED].tolist()), []).append((k, i))
        self.phrases = np.array(list(found), np.int64).reshape(len(found), SEED)
        self.uses = np.array([len(x) for x in found.values()], np.int64)
        self.first_use = np.cumsum(self.uses) - self.uses
        self.where = np.array([w for x in found.values() for w in x], np.int64).reshape(-1, 2)
        self.need = np.array([-(-len(x) * WHOLE_SHARE[0] // WHOLE_SHARE[1]) for x in self.parts], np.int64)
        self.groups: list[_Group] = []
        order = sorted(range(len(parts)), key=lambda k: len(self.parts[k]))
        while order:
            many = min(_GROUP, sum(len(self.parts[k]) <= 2 * len(self.parts[order[0]]) for k in order))
            self.groups.append(_Group(self, order[:many]))
            order = order[many:]


class _Group:
    """Parts of which none is more than twice as long as another, and how often each has each word."""

    def __init__(self, p: _Phrases, ids: list[int]):
        self.ids, self.need = np.array(ids, np.int64), p.need[ids]
        longest = len(p.parts[ids[-1]])
        self.wide = int(longest * STRETCH) + 2
        own = np.unique(np.concatenate([p.parts[k] for k in ids]))
        self.slot = np.full(len(p.words) + 1, -1, np.int64)
        self.slot[own] = np.arange(len(own))
        self.counts = np.zeros((len(own), len(ids)), np.min_scalar_type(-longest - 1))
        for j, k in enumerate(ids):
            np.add.at(self.counts[:, j], self.slot[p.parts[k]], 1)


def _near(g: _Group, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document number, part, first place) of blocks that hold four fifths of the words of a part.

    Blocks begin every ``wide`` words and are twice as long, so each stretch lies whole in the block
    in which it begins; none can be missed, whatever words stand between.
    """
    at = np.flatnonzero(g.slot[codes] >= 0)
    doc = np.searchsorted(starts, at, "right") - 1
    lengths = np.diff(np.append(starts, len(codes)))
    blocks = -(-lengths // g.wide)
    base = np.cumsum(blocks) - blocks
    nth = (at - starts[doc]) // g.wide
    block, slot, later = base[doc] + nth, g.slot[codes[at]], nth > 0
    block, slot = np.concatenate([block, block[later] - 1]), np.concatenate([slot, slot[later]])
    full = np.bincount(block, minlength=1)[block] >= g.need.min()
    key = np.unique(block[full] * len(g.counts) + slot[full])
    block, slot = np.divmod(key, len(g.counts))
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    tails = np.append(heads[1:], len(block))
    i = 0
    while i < len(heads):
        j = max(i + 1, int(np.searchsorted(tails, heads[i] + _ROWS, "right")))
        sums = np.add.reduceat(g.counts[slot[heads[i] : tails[j - 1]]], heads[i:j] - heads[i], axis=0, dtype=g.counts.dtype)
        for r, c in np.argwhere(sums >= g.need):
            b = int(block[heads[i + r]])
            d = int(np.searchsorted(base, b, "right")) - 1
            yield d, int(g.ids[c]), int(starts[d] + (b - base[d]) * g.wide)
        i = j


def _common(part: np.ndarray, stretch: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[int, int] = {}
    for i, w in enumerate(part.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(part)) - 1
    v = full
    for w in stretch.tolist():
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(part) - v.bit_count()


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of places that follow each other."""
    head = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return head, (np.append(head[1:], len(places)) - 1)[: len(head)]


def _verbatim(p: _Phrases, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document number, part, first word, end word) of the runs of an item's words in one shard."""
    # words of no item, and ends of documents, separate; runs too short for a passage go
    known = codes > 0
    edge = np.zeros(len(codes) + 1, bool)
    edge[starts] = True
    run = np.cumsum(edge[:-1] | ~known | np.concatenate([[True], ~known[:-1]])) - 1
    length = np.bincount(run[known], minlength=run[-1] + 1 if len(run) else 0)
    keep = known.copy()
    keep[known] = length[run[known]] >= RUN_WORDS
    at = np.flatnonzero(keep)
    if not len(at) or not len(p.phrases):
        return
    gap = np.concatenate([[True], run[at][1:] != run[at][:-1]])
    slot = np.arange(len(at)) + np.cumsum(gap)
    seq = np.zeros(slot[-1] + 2, np.int64)
    seq[slot] = codes[at]
    place = np.zeros(len(seq), np.int64)
    place[slot] = at

    from linkloom.llm.fm_index import FMIndex

    index = FMIndex(seq, len(p.words))
    lo, hi = index.search(p.phrases)
    some = hi - lo
    which = np.repeat(np.arange(len(p.phrases)), some)
    nth = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
    spot = place[index.locate(lo[which] + nth)]
    # at each place one phrase begins; a passage is as many phrases in a row
    order = np.argsort(spot)
    spot, which = spot[order], which[order]
    row = RUN_WORDS - SEED + 1
    for a, b in zip(*_runs(spot), strict=True):
        if b - a + 1 < row:
            continue
        # every passage has a place of each remainder: those with the fewest parts are looked at, so that
        # wording shared by many items is multiplied by none of them
        uses = p.uses[which[a : b + 1]]
        rest = int(np.argmin(np.bincount(np.arange(len(uses)) % row, uses, minlength=row)))
        doc = int(np.searchsorted(starts, spot[a], "right")) - 1
        low, high = int(spot[a]), int(spot[b]) + SEED
        seen = set()
        for i in range(a + rest, b + 1, row):
            first = p.first_use[which[i]]
            for k, offset in p.where[first : first + p.uses[which[i]]].tolist():
                begin = int(spot[i]) - offset
                if (k, begin) in seen:
                    continue
                seen.add((k, begin))
                part = p.parts[k]
                x, y = max(low, begin), min(high, begin + len(part))
                same = np.flatnonzero(codes[x:y] == part[x - begin : y - begin])
                for h, t in zip(*_runs(same), strict=True):
                    if t - h + 1 >= RUN_WORDS:
                        yield doc, int(k), x + int(same[h]), x + int(same[t]) + 1


def _whole(p: _Phrases, codes: np.ndarray, starts: np.ndarray, done: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Whole parts with some words changed, the first stretch of each in a document; done ones are left out."""
    for g in p.groups:
        for d, k, first in _near(g, codes, starts):
            if (d, k) in done:
                continue
            words, need = p.parts[k], int(p.need[k])
            stop = int(starts[d + 1]) if d + 1 < len(starts) else len(codes)
            places = first + np.flatnonzero(np.isin(codes[first : min(stop, first + 2 * g.wide)], words))
            if len(places) < need or _common(words, codes[places]) < need:
                continue
            reach = int(len(words) * STRETCH) + 2
            ends = np.searchsorted(places, places + reach)
            able = np.flatnonzero(ends - np.arange(len(places)) >= need)
            for i in able[places[able] < first + g.wide]:
                if _common(words, codes[places[i : ends[i]]]) >= need:
                    done.add((d, k))
                    # of the stretches that overlap it the one with most words, without what is beside them
                    near = able[(able >= i) & (able < ends[i])]
                    i = max(near, key=lambda x: _common(words, codes[places[x : ends[x]]]))
                    own = places[i : ends[i]]
                    most = _common(words, codes[own])
                    own = own[: bisect_left(range(len(own)), most, key=lambda x: _common(words, codes[own[:x]]))]
                    own = own[bisect_left(range(len(own)), True, key=lambda x: _common(words, codes[own[x + 1 :]]) < most) :]
                    yield d, k, int(own[0]), int(own[-1]) + 1
                    break


def _passages(p: _Phrases, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document number, part, first word, end word) of the passages in one shard."""
    done = set()
    for found in _verbatim(p, codes, starts):
        done.add(found[:2])
        yield found
    yield from _whole(p, codes, starts, done)


def _find(p: _Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            lists, keys = table["words"].combine_chunks(), table["key"].combine_chunks()
            codes = pc.fill_null(pc.add(pc.index_in(lists.flatten(), p.words), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            # documents without words have no place of their own
            real = np.flatnonzero(lengths > 0)
            found = list(_passages(p, codes, starts[real])) if len(real) else []
            rows = real[[f[0] for f in found]] if found else np.zeros(0, np.int64)
            base = starts[rows]
            return pa.RecordBatch.from_arrays([
                keys.take(pa.array(rows, pa.int64())), pa.array([p.items[f[1]] for f in found], pa.int64()),
                pa.array([f[2] for f in found] - base, pa.int64()), pa.array([f[3] for f in found] - base, pa.int64()),
            ], ["key", "item_id", "first_word", "end_word"])

        for batch in batches:
            words = words_of(batch.column(1))
            held.append(pa.RecordBatch.from_arrays([batch.column(0), words], ["key", "words"]))
            size += len(words.values)
            if size >= SHARD_WORDS:
                yield shard()
                held, size = [], 0
        if held:
            yield shard()

    return run


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, first_word, end_word): passages of items in documents, by places of words.

    A passage is 12 consecutive words of an item's text or answer, or a stretch with four fifths of
    the words of all of it in their order. Null and empty texts, on either side, have no passages;
    documents that occur twice and items with the same wording give rows of their own. Documents are
    read whole, whatever their length; empty tables give no rows. Items are looked up in blocks of
    ITEMS_PER_BLOCK or BYTES_PER_BLOCK, so that what goes to the tasks has a bound.
    """
    slim = spread(documents.filter(F.char_length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = dict(slim.dtypes)["key"]
    parts = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array("text", "answer")).alias("part")).filter("item_id is not null and part is not null")
    schema = f"key {kind}, item_id bigint, first_word bigint, end_word bigint"
    out = None
    many = parts.agg(F.count_distinct("item_id").alias("n"), F.coalesce(F.sum(F.octet_length("part")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-many["n"] // ITEMS_PER_BLOCK), -(-many["bytes"] // BYTES_PER_BLOCK))
    for b in range(blocks):
        rows = parts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        words = words_of(pa.array([r[1] for r in rows], pa.string())).to_pylist()
        block = [(r[0], w) for r, w in zip(rows, words, strict=True) if w]
        if block:
            found = slim.mapInArrow(_find(_Phrases(block)), schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = documents.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)


def leaked_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping passages of a document merged: (key, first_word, end_word, items)."""
    w = Window.partitionBy(key).orderBy("first_word", "end_word")
    before = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("fresh", F.when(before >= F.col("first_word"), 0).otherwise(1))
    island = fresh.withColumn("span", F.sum("fresh").over(w))
    return island.groupBy(key, "span").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.array_sort(F.collect_set("item_id")).alias("items")).drop("span")
