"""Evaluation items that leaked into training text, found with suffix arrays of the training text.

Texts count by their letters, marks and digits only, apart from case and width.  Each shard of
training text gets a suffix array, sorted to the depth of a seed; every suffix of every item is
searched in it by bisection, which gives the places of all verbatim matches of that depth, and those
that follow one another on a diagonal are the longest verbatim matches.  A
suffix of the shard whose first characters begin no item suffix cannot be found, so it is left out
before sorting.  Every match is grown over small changes in both directions; a document leaks an
item if it holds at least half of it as one connected passage.

The depth of a seed is 24 characters, 12 in dense scripts, and at most about half of an item: 12 for
items under 48 characters (dense scripts: 24), 6 for items under 24 (12), and the whole of an item
under 12 (6), which counts as held only where it stands verbatim.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.textcodes import chunks, code_points, folding, joined

#: Characters in one machine word of a suffix, five bits each; a seed is at most two words deep.
WORD = 12
#: Share of an item that a leak holds, and the longest change (in characters) that a passage bridges.
SHARE, BRIDGE = 0.5, 20
#: Characters of items that are searched at a time.
ITEM_BLOCK = 2_000_000
BLOOM = 1 << 22


def dense(cp: np.ndarray) -> np.ndarray:
    """Characters that say as much as several letters: kana, ideographs and Korean syllables."""
    return (cp >= 0x3040) & (cp <= 0x9FFF) | (cp >= 0xAC00) & (cp <= 0xD7AF) | (cp >= 0x1100) & (cp <= 0x11FF) | (cp >= 0xF900) & (cp <= 0xFAFF) | (cp >= 0x20000)


def seed_depths(folded: np.ndarray) -> np.ndarray:
    """Depth of the seed that begins at each character of an item."""
    length = len(folded)
    full = np.where(dense(folded), WORD, 2 * WORD)
    if length < 6 or length < 12 and not dense(folded).any():
        return np.full(length, length)
    return np.minimum(full, WORD if length >= 24 else 6) if length < 48 else full


def words(folded: np.ndarray) -> np.ndarray:
    """The first WORD characters from each place as a number that sorts as they do (by their codes)."""
    small = ((folded * np.uint32(2654435761)) >> np.uint32(27)).astype(np.uint64)
    n = len(small)
    padded = np.concatenate([small, np.zeros(WORD, np.uint64)])
    out = np.zeros(n, np.uint64)
    for k in range(WORD):
        out = (out << np.uint64(5)) | padded[k : k + n]
    return out


def bucket(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


class ItemSuffixes:
    """Every suffix of every item, ready to be searched in the suffix arrays of shards."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        table = folding()
        parts = [table[code_points(t or "")] for t in texts]
        self.folded = [p[p > 0] for p in parts]
        self.strings = ["".join(map(chr, p.tolist())) for p in self.folded]
        # characters in a row that have to agree where a match goes on after a change
        self.least = [4 if 2 * int(dense(p).sum()) >= len(p) else 8 for p in self.folded]
        self.lengths = np.array([len(p) for p in self.folded], np.int64)
        self.owner = np.repeat(np.arange(len(ids)), self.lengths)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.place = cat([np.arange(n) for n in self.lengths], np.int64)
        self.flat = cat(self.folded, np.uint32)
        self.first = cat([words(p) for p in self.folded], np.uint64)
        self.second = cat([np.concatenate([words(p)[WORD:], np.zeros(min(WORD, len(p)), np.uint64)]) for p in self.folded], np.uint64)
        self.depth = cat([seed_depths(p) for p in self.folded], np.int64)
        left = self.lengths[self.owner] - self.place
        #: (depth, suffixes searched to it, which of a shard's words can begin one, and which can follow)
        self.tiers = []
        for depth in sorted(set(self.depth.tolist())):
            which = np.flatnonzero((self.depth == depth) & (left >= depth))
            begins = np.zeros(BLOOM, bool)
            begins[bucket(cropped(self.first[which], depth))] = True
            follows = np.zeros(BLOOM, bool)
            follows[bucket(self.second[which])] = True
            self.tiers.append((depth, which, begins, follows))
        self.deep = next((t[1] for t in self.tiers if t[0] == 2 * WORD), np.zeros(0, np.int64))


def cropped(key: np.ndarray, depth: int) -> np.ndarray:
    """The words of at most ``depth`` characters."""
    return key >> np.uint64(5 * (WORD - depth)) if depth < WORD else key


def grow(q: str, t: str, p: int, d: int, least: int) -> tuple[int, int, int]:
    """Grow the match of q[p:] and t[d:] to the right over changes of up to BRIDGE characters.

    Returns the characters of q that are held (changed ones do not count), and the ends in q and t.
    """
    held = 0
    nq, nt = len(q), len(t)
    while True:
        run = 0
        limit = min(nq - p, nt - d)
        while run < limit and q[p + run] == t[d + run]:
            run += 1
        held, p, d = held + run, p + run, d + run
        best = None
        for ga in range(BRIDGE + 1):
            piece = q[p + ga : p + ga + least]
            if len(piece) < least:
                break
            gb = t.find(piece, d, d + BRIDGE + least) - d
            if gb >= 0 and (best is None or ga + gb < best[0] + best[1]):
                best = ga, gb
            if best is not None and ga >= best[0] + best[1]:
                break
        if best is None:
            return held, p, d
        ga, gb = best
        p, d = p + ga, d + gb


def suffix_matches(shard: np.ndarray, items: ItemSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(item suffix, place in the shard) of every verbatim match of seed depth."""
    whole_key = words(shard)
    found_suffix, found_place = [], []
    for depth, which, begins, follows in items.tiers:
        if not len(which):
            continue
        key = cropped(whole_key, depth)
        slot = bucket(key)
        can = begins[slot]
        if depth > WORD:
            can &= follows[np.concatenate([slot[WORD:], np.zeros(min(WORD, len(slot)), np.int64)])]
        places = np.flatnonzero(can)
        if not len(places):
            continue
        one, sought = key[places], cropped(items.first[which], depth)
        if depth > WORD:
            two = key[np.minimum(places + WORD, len(key) - 1)]
            heads, rank_one = np.unique(one, return_inverse=True)
            tails, rank_two = np.unique(two, return_inverse=True)
            rank = rank_one * len(tails) + rank_two
            h = np.minimum(np.searchsorted(heads, sought), len(heads) - 1)
            t = np.minimum(np.searchsorted(tails, items.second[which]), len(tails) - 1)
            known = (heads[h] == sought) & (tails[t] == items.second[which])
            one, sought = rank, np.where(known, h * len(tails) + t, -1)
        order = np.argsort(one, kind="stable")  # the suffix array
        one, places = one[order], places[order]
        low, high = np.searchsorted(one, sought, "left"), np.searchsorted(one, sought, "right")
        n = high - low
        hit = np.flatnonzero(n)
        if len(hit):
            n = n[hit]
            at = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            suffix, place = np.repeat(which[hit], n), places[at]
            if depth < WORD:  # few characters are as likely by chance in the five bits of each: they have to agree in full
                same = np.ones(len(suffix), bool)
                for k in range(depth):
                    same &= items.flat[suffix + k] == shard[np.minimum(place + k, len(shard) - 1)]
                suffix, place = suffix[same], place[same]
            found_suffix.append(suffix)
            found_place.append(place)
    if not found_suffix:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_suffix), np.concatenate(found_place)


def leaks_of(texts: list[str | None], items: ItemSuffixes) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item, share held, longest verbatim match, begin and end of the passage in the text) of every pair that reaches SHARE."""
    table = folding()
    raw, offsets = joined(texts)
    folded = table[raw]
    keep = folded > 0
    keep[offsets[1:] - 1] = True  # a zero stays between texts
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    bounds = kept_before[offsets]
    shard, raw_place = folded[keep], np.flatnonzero(keep)
    suffix, place = suffix_matches(shard, items)
    if not len(suffix):
        return []
    row = np.searchsorted(bounds, place, "right") - 1
    item, begin = items.owner[suffix], items.place[suffix]
    diagonal = place - begin
    depth = items.depth[suffix]
    order = np.lexsort((begin, diagonal, item, row))
    row, item, begin, diagonal, place, depth = (x[order] for x in (row, item, begin, diagonal, place, depth))
    # maximal runs: neighbouring seeds on one diagonal
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (begin[1:] > begin[:-1] + depth[:-1])
    starts = np.flatnonzero(new)
    last = np.concatenate([starts[1:], [len(row)]]) - 1
    run_len = begin[last] + depth[last] - begin[starts]
    r_row, r_item, r_begin, r_place = row[starts], item[starts], begin[starts], place[starts]
    pair_new = np.ones(len(starts), bool)
    pair_new[1:] = (r_row[1:] != r_row[:-1]) | (r_item[1:] != r_item[:-1])
    first = np.flatnonzero(pair_new)
    ends = np.concatenate([first[1:], [len(starts)]])
    out = []
    current = None
    for i, j in zip(first.tolist(), ends.tolist(), strict=True):
        it, rw = int(r_item[i]), int(r_row[i])
        q = items.strings[it]
        if rw != current:
            current, base = rw, int(bounds[rw])
            t = "".join(map(chr, shard[base : int(bounds[rw + 1]) - 1].tolist()))
            reverse = t[::-1]
        if len(t) < SHARE * len(q):
            continue
        least = items.least[it]
        best, reached = 0.0, (0, 0)
        for m in i + np.argsort(-run_len[i:j], kind="stable"):
            p, d = int(r_begin[m]), int(r_place[m]) - base
            right = grow(q, t, p, d, least)
            left = grow(q[:p][::-1], reverse[len(t) - d :], 0, 0, least)
            share = (right[0] + left[0]) / len(q)
            if share > best:
                best, reached = share, (d - left[2], right[2])
        if best >= SHARE:
            begin_raw, end_raw = (int(raw_place[base + reached[0]]), int(raw_place[base + reached[1] - 1]) + 1) if reached[1] > reached[0] else (0, 0)
            out.append((rw, it, best, int(run_len[i:j].max()), begin_raw - int(offsets[rw]), end_raw - int(offsets[rw])))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, share, matched, start_char, end_char)`` of every document that holds at least half of an item:
    the share held, the characters of the longest verbatim match, and where in the text the passage stands.

    One narrow pass over the documents for each block of items; items are the stated query set and
    are shipped in blocks of ITEM_BLOCK characters, so what a task holds is bounded.  Null and
    empty texts leak nothing; items without letters or digits leak nowhere; an item of under 12
    characters (6 in dense scripts) leaks where it stands whole; repeated documents and items give
    repeated rows; a text of any length is searched whole.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    known = items.select(F.col(item_id), F.col(item_text)).filter(F.col(item_text).isNotNull())
    size = known.agg(F.sum(F.length(item_text)).alias("n")).collect()[0]["n"] or 0
    blocks = -(-size // ITEM_BLOCK) or 1
    result = None
    for b in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)
        rows = part.collect()  # one block of the query set
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            suffixes = ItemSuffixes(ids, texts)
            for batch in batches:
                column = batch.column(1).to_pylist()
                for begin, end in chunks(column):
                    found = leaks_of(column[begin:end], suffixes)
                    who = batch.column(0).take(pa.array([begin + f[0] for f in found], pa.int64()))
                    places = [pa.array([f[k] for f in found], pa.int64()) for k in (3, 4, 5)]
                    yield pa.RecordBatch.from_arrays([who, pa.array([ids[f[1]] for f in found], docs_item_type), pa.array([f[2] for f in found], pa.float64()), *places], [doc_id, "item_id", "share", "matched", "start_char", "end_char"])

        docs_item_type = pa.int64() if kinds[1] == "bigint" else pa.string()
        found = docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kinds[0]}, item_id {kinds[1]}, share double, matched bigint, start_char bigint, end_char bigint")
        result = found if result is None else result.unionByName(found)
    return result


def remove_leaking(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without those that leak an item."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
