"""Documents that share most of their word shingles: an exact n-gram Jaccard join by PartEnum signatures.

A document's set is its distinct shingles of five words, as 64-bit hashes. Sets of similarity ``T / 100`` or more differ in
at most ``(100 - T) / (100 + T)`` of the sum of their sizes. The join takes four steps, each exact:

1. *Repeated features.* A set with a partner shares all but ``(100 - T) / 100`` of its shingles, so at least that many,
   less the same number, of those in one half of the feature domain must occur in another set too. Every task reduces its
   sets to the distinct fingerprints of that half, those meet by ranges, and sets with too few repeated ones end here.
2. *PartEnum signatures.* Sets are put into size bands; a pair of bands that partners can lie in has a bound ``k`` on their
   difference. The domain is cut into ``n1`` regions of ``PARTS`` partitions. More than ``k / (SPOILT + 1)`` regions mean
   that partners differ in at most ``SPOILT`` partitions of some region, so of all subsets of ``PARTS - SPOILT`` partitions
   of a region, each hashed to a signature, they share one. Subsets without elements are left out; a set with too few
   regions of more than ``SPOILT`` filled partitions also emits its first ``k + 1`` shingles by hash (prefix principle).
3. *Pairs are tested before anything is united.* Each set carries the parities of its shingles over a power of two of slots
   near its size; two sets differ at least by the slots in which their parities do. Pairs that share a signature, have sizes
   that allow a link and don't differ too much by that bound make candidate families.
4. *Exact comparison* in a family: rare shingles first, by prefixes; sets already connected aren't compared. Families beyond
   ``UNIT`` shingles, and buckets of signatures beyond ``BUCKET`` entries, are dealt out as pairs of blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, short_batches
from .components import DisjointSets, components, forest
from .membership import members as slot_members
from .membership import perhaps, slot, slot_bits

WIDTH = 5
PARTS, SPOILT, SLACK, SPARE = 3, 1, 1.25, 3
FINGERPRINT = 48  # bits; equal ones of different shingles only keep a set longer
CHUNK, CHUNK_SETS = 1_500_000, 65_000  # fingerprints and sets held by a task
RANGE = 1_000_000  # fingerprints a range
FLUSH, BUCKET = 600_000, 1_000_000  # signatures held by a task, and met in one place
SMALL = 12  # sets of a signature compared with others' all at once
UNIT = 1_000_000  # shingles of the sets compared in one task
MAX_WORDS_CACHED = 200_000
LONGEST = 64  # words of a parity sketch
SIGN = 1 << 63
NOBODY = 0xFFFF

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SUBSETS = list(itertools.combinations(range(PARTS), PARTS - SPOILT))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Distinct shingles of texts, as sorted 64-bit hashes; a worker keeps the hashes of words it has seen."""

    def __init__(self):
        self.words = _Words()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if len(words) < WIDTH:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64) if words else np.zeros(0, np.uint64)
        if len(self.words) > MAX_WORDS_CACHED:
            self.words.clear()
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(words) - WIDTH + 1
        h = w[:n] * _FACTORS[0]
        for i in range(1, WIDTH):
            h += w[i : n + i] * _FACTORS[i]
        return np.unique(mix(h))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - SIGN


def most_apart(sizes, percent: int):
    """The most shingles in which linked sets of this sum of sizes differ."""
    return sizes * (100 - percent) // (100 + percent)


# Step 1: repeated features


def _packed(values: np.ndarray) -> bytes:
    """Sorted values as differences of 32 bits, or whole where one is larger."""
    gaps = np.diff(values, prepend=np.uint64(0))
    if len(gaps) and gaps[1:].max(initial=0) < 1 << 32:
        return b"\1" + values[:1].tobytes() + gaps[1:].astype(np.uint32).tobytes()
    return b"\0" + values.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, np.uint64, offset=1)
    gaps = np.frombuffer(data, np.uint32, offset=9).astype(np.uint64)
    return np.cumsum(np.r_[np.frombuffer(data, np.uint64, 1, 1), gaps])


def _scan(percent: int, ranges: int):
    """A row per document (its set's id and size); per chunk of sets its ids and needs (``names``), and per range its fingerprints."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, seen = Shingler(), {}
        prints: list[np.ndarray] = []
        needs: list[int] = []
        size = 0

        def chunk() -> pd.DataFrame:
            values = np.concatenate(prints)
            owners = np.repeat(np.arange(len(prints), dtype=np.uint16), [len(p) for p in prints])
            prints.clear()
            order = np.argsort(values)
            values, owners = values[order], owners[order]
            first = np.r_[True, values[1:] != values[:-1]]
            alone = first & np.r_[first[1:], True]
            need = np.array(needs) - np.bincount(owners[~alone], minlength=len(needs))  # what the chunk itself repeats is settled
            owners[~alone] = NOBODY
            values, owners = values[first], owners[first]
            ids = np.fromiter(seen, np.int64, len(seen))
            name = xxhash.xxh3_64_intdigest(ids.tobytes()) - SIGN
            cut = np.searchsorted(values, (np.arange(ranges + 1) * ((1 << FINGERPRINT) / ranges)).astype(np.uint64))
            cut[-1] = len(values)
            rows = [(name % ranges, name, None, ids.tobytes() + need.astype(np.int32).tobytes())]
            rows += [(k, name, _packed(values[i:j]), owners[i:j].tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            return pd.DataFrame(rows, columns=["range", "chunk", "prints", "owners"]).assign(doc=None, text=0, id=0, n=0)

        for pdf in batches:
            ids, sizes = [], []
            for text in pdf["text"]:
                s = shingle(text)
                ids.append(own := set_id(s))
                sizes.append(len(s))
                if len(s) and own not in seen:
                    seen[own] = None
                    half = s[s & np.uint64(1) == 0] >> np.uint64(64 - FINGERPRINT)
                    half = half[np.r_[True, half[1:] != half[:-1]]] if len(half) else half
                    prints.append(half)
                    needs.append(len(half) - (len(s) - -(-len(s) * percent // 100)))
                    size += len(half)
                    if size > CHUNK or len(seen) >= CHUNK_SETS:
                        yield chunk()
                        size = 0
                        seen.clear()
                        needs.clear()
            yield pd.DataFrame({"range": -1, "chunk": 0, "prints": None, "owners": None, "doc": pdf["doc"], "text": pdf["print"], "id": ids, "n": sizes})
        if seen:
            yield chunk()
        release_memory()

    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk, the owners of fingerprints of one range that another chunk has too; names pass."""
    named = pdf["prints"].isna().to_numpy()
    out = [pdf.loc[named, ["chunk"]].assign(names=pdf.loc[named, "owners"], owners=None)]
    chunks = pdf.loc[~named, "chunk"].to_numpy()
    if len(chunks):
        values = [_unpacked(p) for p in pdf.loc[~named, "prints"]]
        owners = [np.frombuffer(o, np.uint16) for o in pdf.loc[~named, "owners"]]
        place = np.repeat(np.arange(len(values)), [len(v) for v in values])
        flat, who = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(flat)
        same = flat[order][1:] == flat[order][:-1]
        again = np.zeros(len(flat), bool)
        again[order] = np.r_[False, same] | np.r_[same, False]
        again &= who != NOBODY
        ends = np.searchsorted(place[again], np.arange(len(values) + 1))
        found = who[again]
        out.append(pd.DataFrame({"chunk": chunks, "names": None, "owners": [found[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]}))
    release_memory()
    return pd.concat(out)[["chunk", "names", "owners"]]


def _lasting(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ids of a chunk's sets that have as many repeated fingerprints as a partner needs."""
    found = np.concatenate([np.zeros(0, np.uint16)] + [np.frombuffer(o, np.uint16) for o in pdf["owners"] if o is not None])
    data = next(x for x in pdf["names"] if x is not None)  # the same chunk, made twice of the same sets, has one name
    ids = np.frombuffer(data, np.int64, len(data) // 12)
    need = np.frombuffer(data, np.int32, offset=len(ids) * 8)
    return pd.DataFrame({"id": ids[np.bincount(found, minlength=len(ids))[: len(ids)] >= need]})


# Step 2: signatures


def bands(percent: int, longest: int) -> np.ndarray:
    """Least sizes of the bands: a partner of a set lies in its band or one beside it."""
    out = [1]
    while out[-1] <= longest:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def band_pairs(s: int, percent: int, low: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(Number of a band pair, its regions, the set's most differing shingles) for all pairs in which a partner of a set of size ``s`` can lie."""
    i = int(np.searchsorted(low, s, side="right")) - 1
    largest, least = s * 100 // percent, -(-s * percent // 100)
    out = [(2 * i, 2 * (low[i + 1] - 1), s + min(largest, low[i + 1] - 1))]
    if largest >= low[i + 1]:
        out.append((2 * i + 1, low[i + 1] - 1 + min(low[i + 2] - 1, (low[i + 1] - 1) * 100 // percent), s + largest))
    if i and least < low[i]:
        out.append((2 * i - 1, low[i] - 1 + min(low[i + 1] - 1, (low[i] - 1) * 100 // percent), s + low[i] - 1))
    return [(pair, regions(int(most_apart(both, percent))), int(most_apart(own, percent))) for pair, both, own in out if most_apart(own, percent) > 0]


def regions(k: int) -> int:
    return int((k // (SPOILT + 1) + 1) * SLACK) + SPARE


def signatures(s: np.ndarray, percent: int, low: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The signatures of a set, by band pair. Sets that differ in nothing have one id and need none."""
    for pair, n1, k in band_pairs(len(s), percent, low):
        cell = ((mix(s ^ _FACTORS[3] + np.uint64(pair)) >> np.uint64(32)) * np.uint64(n1 * PARTS) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        filled, starts = np.unique(cell[order], return_index=True)
        sums = np.zeros(n1 * PARTS, np.uint64)
        sums[filled] = np.add.reduceat(mix(s[order] + np.uint64(pair)), starts)
        full = np.zeros(n1 * PARTS, bool)
        full[filled] = True
        sums, full = sums.reshape(n1, PARTS), full.reshape(n1, PARTS)
        salt = mix(np.arange(n1 * len(_SUBSETS), dtype=np.uint64).reshape(n1, -1) + np.uint64(pair << 32))
        out = [mix(sums[:, sub].sum(1, dtype=np.uint64) + salt[:, j])[full[:, sub].any(1)] for j, sub in enumerate(_SUBSETS)]
        if (full.sum(1) > SPOILT).sum() <= k // (SPOILT + 1):
            out.append(np.sort(mix(s ^ _FACTORS[2] + np.uint64(pair)))[: k + 1])
        yield pair, np.concatenate(out)


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of the parity sketches of sets of these sizes."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64), 1, LONGEST)


def parities(s: np.ndarray) -> np.ndarray:
    bits = 64 * int(sketch_words(np.array([len(s)]))[0])
    odd = np.bincount((mix(s ^ _FACTORS[4]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _emit(percent: int, low: np.ndarray, buckets: np.ndarray):
    """Signatures by bucket; ``buckets`` has the first one of each band pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        size = 0

        def out() -> pd.DataFrame:
            rows = []
            for pair, sets in held.items():
                sigs = np.concatenate([x[2] for x in sets])
                owner = np.repeat(np.arange(len(sets)), [len(x[2]) for x in sets])
                first, many = int(buckets[pair]), int(buckets[pair + 1] - buckets[pair])
                bucket = ((sigs >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(many + 1))
                for b in range(many):
                    at = order[cut[b] : cut[b + 1]]
                    if len(at):
                        own, place = np.unique(owner[at], return_inverse=True)
                        ids, sizes = np.array([sets[i][0] for i in own], np.int64), np.array([sets[i][1] for i in own], np.int32)
                        head = ids.tobytes() + sizes.tobytes()
                        rows.append((first + b, len(at), len(own), sigs[at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), place.astype(np.uint32).tobytes(), head, np.concatenate([sketches[sets[i][0]] for i in own]).tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "n", "sets", "sigs", "place", "head", "sketch"])

        sketches: dict[int, np.ndarray] = {}
        for pdf in batches:
            for own, data in zip(pdf["id"], pdf["shingles"], strict=True):
                s = np.frombuffer(data, np.uint64)
                for pair, sigs in signatures(s, percent, low):
                    held.setdefault(pair, []).append((own, len(s), sigs))
                    size += len(sigs)
                sketches[own] = parities(s)
            if size > FLUSH:
                yield out()
                held.clear()
                sketches.clear()
                size = 0
        if held:
            yield out()
        held.clear()
        release_memory()

    return run


# Step 3: tests of pairs


class Sketched:
    """Sets with their parity sketches: tells for pairs of positions whether a link is possible."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes], percent: int):
        self.sizes, self.percent = sizes, percent
        self.words = sketch_words(sizes)
        data = np.frombuffer(b"".join(sketches), np.uint64)
        starts = np.r_[0, np.cumsum(self.words)]
        self.rows, self.row = {}, {}
        for w in np.unique(self.words):
            for width, own in ((w, np.flatnonzero(self.words == w)), (2 * w, np.flatnonzero(self.words == 2 * w))):
                if not len(own):
                    continue
                x = data[starts[own][:, None] + np.arange(width)]
                x = x if width == w else x[:, :w] ^ x[:, w:]  # a sketch folds into one of half its slots
                at = self.row.setdefault(int(w), np.full(len(sizes), -1, np.int64))
                have = self.rows.get(int(w))
                at[own] = np.arange(len(own)) + (0 if have is None else len(have))
                self.rows[int(w)] = x if have is None else np.concatenate([have, x])

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        good = small * 100 >= large * self.percent
        width = np.minimum(self.words[a], self.words[b])
        limit = most_apart(small + large, self.percent)
        for w, rows in self.rows.items():
            at = np.flatnonzero(good & (width == w))
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                apart = np.bitwise_count(rows[self.row[w][a[part]]] ^ rows[self.row[w][b[part]]]).sum(1, dtype=np.int64)
                good[part] = apart <= limit[part]
        return good


def meet(sigs: np.ndarray, owner: np.ndarray, sets: Sketched, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all pairs of sets (positions) that share a signature and may be linked; with ``side``, pairs of both sides only."""
    order = np.argsort(sigs, kind="stable")
    sigs, owner = sigs[order], owner[order]
    bounds = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1], True]) if len(sigs) else np.zeros(1, np.int64)
    counts = np.diff(bounds)
    none = np.zeros(0, np.int64)
    left, right = [none], [none]
    for c in range(2, SMALL + 1):
        groups = owner[bounds[:-1][counts == c][:, None] + np.arange(c)]
        for i, j in itertools.combinations(range(c), 2):
            left.append(groups[:, i])
            right.append(groups[:, j])
    a, b = np.concatenate(left), np.concatenate(right)
    del left, right
    a, b = np.minimum(a, b), np.maximum(a, b)
    a, b = np.divmod(np.unique(a * len(sets.sizes) + b), max(1, len(sets.sizes)))
    if side is not None:
        across = side[a] != side[b]
        a, b = a[across], b[across]
    good = sets.possible(a, b)
    a, b = forest(a[good], b[good])
    joined = DisjointSets(len(sets.sizes))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        joined.unite(x, y)
    edges = [(a, b)]
    for k in np.flatnonzero(counts > SMALL):
        own = np.unique(owner[bounds[k] : bounds[k + 1]])
        label = np.array([joined.find(x) for x in own.tolist()])
        names, size = np.unique(label, return_counts=True)
        if len(names) < 2:
            continue
        for x in own[label != names[size.argmax()]].tolist():  # all but the largest class against everything
            others = own[np.array([joined.find(y) for y in own.tolist()]) != joined.find(x)] if len(own) <= 64 else own[own != x]
            if side is not None:
                others = others[side[others] != side[x]]
            near = others[sets.possible(np.full(len(others), x), others)]
            fresh = [y for y in near.tolist() if joined.unite(x, y)]
            edges.append((np.full(len(fresh), x), np.array(fresh, np.int64)))
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])


def _meet(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, base = [], 0
        sigs, owner, sizes, ids, side = [], [], [], [], []
        for r in pdf.itertuples():
            ids.append(np.frombuffer(r.head, np.int64, r.sets))
            sizes.append(np.frombuffer(r.head, np.int32, r.sets, r.sets * 8).astype(np.int64))
            wide = np.zeros((r.n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(r.sigs, np.uint8).reshape(-1, 6)
            sigs.append(wide.view(np.uint64)[:, 0])
            owner.append(np.frombuffer(r.place, np.uint32).astype(np.int64) + base)
            side.append(np.full(r.sets, r.side))
            heads.append(r.sketch)
            base += r.sets
        ids, side = np.concatenate(ids), np.concatenate(side)
        sets = Sketched(np.concatenate(sizes), heads, percent)
        a, b = meet(np.concatenate(sigs), np.concatenate(owner), sets, side if side.max() > 0 else None)
        a, b = forest(ids[a], ids[b])
        release_memory()
        return pd.DataFrame({"a": a, "b": b})

    return run


# Step 4: exact comparison


def _sets(slots):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, member = Shingler(), slot_members(slots.value)
        for pdf in batches:
            sets = [shingle(t) for t in pdf["text"][member[pdf["slot"].to_numpy(np.int64)]]]
            sets = [s for s in sets if len(s)]
            yield pd.DataFrame({"id": [set_id(s) for s in sets], "shingles": [s.tobytes() for s in sets]})
        release_memory()

    return run


def linked(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (positions) of the graph that links sets of Jaccard similarity ``percent`` / 100 or more.

    ``left`` marks the sets of a first block: only links between it and the others are looked for. Sets are searched from one
    that is already reached; those reached are never compared again.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    starts = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(n), sizes)
    rank = np.argsort(np.argsort(count, kind="stable"))  # rare first
    order = np.lexsort((rank[flat], owner))
    prefix = sizes - -(-sizes * percent // 100) + 1
    inside = np.arange(len(flat)) - starts[owner] < prefix[owner]
    tokens, holders = flat[order][inside], owner[inside]
    by_token = np.argsort(tokens, kind="stable")
    tokens, holders = tokens[by_token], holders[by_token]
    bound = np.searchsorted(tokens, np.arange(len(count) + 1))
    mark = np.zeros(len(count), bool)
    open_ = np.ones(n, bool)
    edges: list[tuple[int, int]] = []

    def near(x: int, among: np.ndarray) -> np.ndarray:
        own = flat[starts[x] : starts[x + 1]]
        head = flat[order[starts[x] : starts[x] + prefix[x]]]
        found = np.unique(np.concatenate([holders[bound[t] : bound[t + 1]] for t in head]))
        found = found[among[found] & (sizes[found] * 100 >= sizes[x] * percent) & (sizes[x] * 100 >= sizes[found] * percent)]
        if left is not None:
            found = found[left[found] != left[x]]
        if not len(found):
            return found
        mark[own] = True
        lengths = sizes[found]
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(starts[found] - np.r_[0, ends[:-1]], lengths)
        common = np.add.reduceat(mark[flat[index]].astype(np.int64), np.r_[0, ends[:-1]])
        mark[own] = False
        return found[100 * common >= percent * (sizes[x] + lengths - common)]

    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            for y in near(x, open_):
                open_[y] = False
                edges.append((int(y), x))
                queue.append(int(y))
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _compare(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "side"])
        ids = pdf["id"].to_numpy(np.int64)
        sides = pdf["side"].to_numpy()
        if sides.max() > 0:  # a pair of blocks
            a, b = linked([np.frombuffer(s, np.uint64) for s in pdf["shingles"]], percent, sides == 1)
        else:
            a, b = linked([np.frombuffer(s, np.uint64) for s in pdf["shingles"]], percent)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return run


def _in_blocks(rows: DataFrame, key: str, block, columns: list[str]) -> DataFrame:
    """Rows of ``key`` dealt to pairs of its ``blocks`` blocks: both rows of every pair of rows meet in one ``(key, i, j)``; ``side`` tells the blocks apart."""
    whole = rows.filter("blocks = 1").select(key, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), *columns)
    parts = rows.filter("blocks > 1").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = parts.select(
        key,
        F.least("block", "other").cast("int").alias("i"),
        F.greatest("block", "other").cast("int").alias("j"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
        *columns,
    )
    return whole.union(dealt)


def text_print(text_col: str):
    """A hash that tells texts of one id apart; null is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def link_shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Returns ``id_col, n_shingles, component_id``, one row per input row.

    ``component_id`` is the least non-null id of the documents reachable by links, the row's own included; a document without
    words links with nothing and has its own id. Equal texts and repeated rows link. Null texts have no words. Other columns
    are ignored. Empty input: no rows. Shingles and sets are known by 64-bit hashes.
    """
    return _groups(docs, id_col, text_col, percent).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _groups(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per input row: ``doc, text`` (its print), ``n, component_id, root`` (of the group of sets, null without words)."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_print(text_col).alias("print"))

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(16, size // (12 * RANGE))  # a word and its space take six bytes, and half of the shingles count
    scanned = materialize(texts.mapInPandas(_scan(percent, ranges), "doc string, text long, id long, n long, range long, chunk long, prints binary, owners binary"), "sets")
    rows = scanned.filter("range < 0").select(F.col("doc").cast(kind).alias("doc"), "text", "id", "n")
    met = scanned.filter("range >= 0").select("range", "chunk", "prints", "owners").groupBy("range").applyInPandas(_repeated, "chunk long, names binary, owners binary")
    lasting = met.groupBy("chunk").applyInPandas(_lasting, "id long").distinct()
    per_set = rows.filter("n > 0").groupBy("id").agg(F.min("doc").alias("least"), F.min(slot(F.col("doc"))).alias("slot"), F.min("n").alias("n"))
    lasting = materialize(per_set.join(lasting, "id", "left_semi"), "lasting")

    found = texts.select("text", slot(F.col("doc")).alias("slot")).mapInPandas(_sets(spark.sparkContext.broadcast(slot_bits(lasting))), "id long, shingles binary")
    sets = materialize(found.join(lasting.select("id"), "id", "left_semi").dropDuplicates(["id"]), "shingles")
    # how many signatures each band pair has follows from a histogram of the sizes
    longest = lasting.agg(F.max("n")).first()[0] or 1
    low = bands(percent, longest * 100 // percent + 1)
    level = F.array_position(F.transform(F.array(*[F.lit(int(x)) for x in low]), lambda x: x > F.col("n")), True)
    signed = np.zeros(2 * len(low) + 1, np.int64)
    for r in lasting.groupBy(level.alias("level")).agg(F.count("*").alias("count"), F.max("n").alias("n")).collect():
        for pair, n1, _ in band_pairs(r["n"], percent, low):
            signed[pair] += r["count"] * n1 * len(_SUBSETS)
    buckets = np.r_[0, np.cumsum(np.maximum(1, 2 * signed // BUCKET))]
    emitted = materialize(sets.mapInPandas(_emit(percent, low, buckets), "bucket long, n long, sets long, sigs binary, place binary, head binary, sketch binary"), "signatures")
    blocks = emitted.groupBy("bucket").agg(F.ceil(F.sum("n") / BUCKET).alias("blocks"))
    columns = ["n", "sets", "sigs", "place", "head", "sketch"]
    dealt = _in_blocks(emitted.join(blocks, "bucket"), "bucket", F.pmod(F.xxhash64("head"), F.col("blocks")), columns)
    families = components(dealt.groupBy("bucket", "i", "j").applyInPandas(_meet(percent), "a long, b long"))
    families = families.union(families.select("component", "component").distinct())

    members = materialize(lasting.join(families, F.col("id") == F.col("vertex")).select("id", "least", "n", F.col("component").alias("family")), "members")
    units = members.groupBy("family").agg(F.ceil(F.sum("n") / UNIT).alias("blocks"))
    compared = _in_blocks(sets.join(members.join(units, "family").select("id", "family", "blocks"), "id"), "family", F.pmod(F.xxhash64("id"), F.col("blocks")), ["id", "shingles"])
    links = materialize(compared.groupBy("family", "i", "j").applyInPandas(_compare(percent), "a long, b long"), "links")

    reached = components(links)
    roots = reached.union(reached.select("component", "component").distinct())
    by_root = members.join(roots, F.col("id") == F.col("vertex")).select("id", "least", "component")
    least = by_root.groupBy("component").agg(F.min("least").alias("component_id"))
    per_set = per_set.select("id", "least").join(by_root.select("id", "component"), "id", "left").join(least, "component", "left")
    per_set = per_set.select("id", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "id").alias("root"))
    words = F.col("n") > 0
    own = F.when(words, F.coalesce("component_id", "doc")).otherwise(F.col("doc"))
    return rows.join(per_set, "id", "left").select("doc", "text", "n", own.alias("component_id"), F.when(words, F.col("root")).alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Rows of ``docs``, all columns: of each group of linked documents one row stays, that of the least id.

    A null id stays only where its group has no other id; of several texts of that id the one of least hash stays, and of
    repeated rows one. Documents without words (null and empty texts too) all stay. Columns may have any names. Empty input: no rows.
    """
    links = materialize(_groups(docs, id_col, text_col, percent), "groups").filter("root is not null").select("doc", "text", "root")
    sort = F.struct(F.col("doc").isNull().alias("none"), "doc", "text")
    rows = links.groupBy("root", "doc", "text").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(sort).alias("first"))
    placed = rows.join(first, "root")
    is_first = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("text") == F.col("first.text"))
    key = lambda doc, text: F.concat_ws("|", F.coalesce(doc.cast("string"), F.lit("")), text.cast("string"), doc.isNull().cast("string"))
    name = key(F.col("doc"), F.col("text")).alias("key")
    listed = materialize(placed.filter(~is_first).select(name, F.lit(True).alias("gone")).union(placed.filter(is_first & (F.col("n") > 1)).select(name, F.lit(False).alias("gone"))), "listed")
    clear, unsure = perhaps(docs, key(F.col(id_col), text_print(text_col)), listed)
    row = unsure.select(F.struct(*unsure.columns).alias("row"), key(F.col(id_col), text_print(text_col)).alias("key"))  # the caller's names stay inside a struct
    kept = row.join(listed.filter("gone").select("key"), "key", "left_anti")
    twice = listed.filter("NOT gone").select("key")
    single = kept.join(twice, "key", "left_anti").select("row")
    repeated = kept.join(twice, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return clear.union(single.union(repeated).select("row.*"))
