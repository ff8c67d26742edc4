"""N-gram Jaccard join by parity sketches (operator 10): documents whose sets of word 5-grams have a similarity of 0.75 or more.

A set's shingles are XOR-hashed into a sketch of k blocks of many bits. One shingle more or less flips one bit, so the
Hamming distance of two sketches, and all the more the number of blocks that differ, is at most the symmetric difference
of the sets. Sets of sizes a <= b are similar only if that is at most (1-t)/(1+t) * (a+b), hence at most D(b). With more
than D(b) occupied blocks, two similar sets agree on an occupied block (pigeonhole). k is fixed per size band; a set joins
its own band and the next one if it can be the smaller partner there. Only the fingerprint of a block is shipped. Candidate
pairs are verified on the sets themselves.

Equal sets are one class throughout. In a block that several classes share, the least key is paired with all others; pairs
that sizes and dense parity sketches do not rule out are verified. The classes whose blocks have the same least key are a
group: every pair of similar sets is in one. A block of over ``HOT`` classes is hot. Of a set's blocks only more than D(b)
need to be looked at, if all sets leave out their last ones in one order; the order is that of the groups by frequency, so hot
blocks, such as those of passages that many texts share, are left out where a set has blocks to spare. What is listed is how many
hot blocks of a group a class has, not each of them. Groups whose classes have not
all fallen in one component are then compared by sketches, between components only, in lots; the nearest pairs are verified
and joined, round by round, as long as that pays. What sketches still leave undecided is compared set by set, joining
components on the way, so that a group of m classes gives m - 1 links at most. No link between components is lost, and no
group is listed as all its pairs. A hot block of one slice of documents reaches its shard as one entry for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_name, give_back, giving_back
from .components import connected_components

#: Bounds of the bits of a parity sketch; between them it has two to four bits for each shingle.
LEAST_BITS, MOST_BITS = 256, 65536
#: Classes that share a block, in a slice or in all, beyond which it is hot.
HOT = 64
#: The largest number of blocks to spare that is noted of a set; one with more looks at more of its blocks than it needs to.
_MOST_SPARE = 2**15 - 1
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Sorted distinct 64-bit hashes of the word n-grams of texts (UTF-8 bytes), with a bounded cache of word hashes."""

    def __init__(self, width: int = 5, max_words: int = 100_000):
        import xxhash

        self._hash = xxhash.xxh3_64_digest
        self.width, self._max_words, self._words = width, max_words, {}
        self._factors = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3) ** 9 | 1) & (2**64 - 1)) for i in range(width)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # of bytes: A-Z only, and exactly 0x20 and 0x09-0x0D
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self._words
        hashes = list(map(known.get, words))
        if None in hashes:
            if len(known) > self._max_words:
                known.clear()
            digest = self._hash
            for i, x in enumerate(hashes):
                if x is None:
                    hashes[i] = known[words[i]] = digest(words[i])
        w = np.frombuffer(b"".join(hashes), dtype=np.uint64)
        n = max(1, len(w) - self.width + 1)
        h = np.full(n, len(w) if len(w) < self.width else 0, dtype=np.uint64)
        for i in range(min(self.width, len(w))):
            h += w[i : i + n] * self._factors[i]
        h = _mix(h)
        h.sort()
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(h[1:], h[:-1], out=new[1:])
        return h if new.all() else h[new]


@lru_cache(maxsize=2)
def shingles_of_width(width: int) -> Shingles:
    """One cache for all tasks of a Python worker."""
    return Shingles(width)


def set_key(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def parity_sketch(shingles: np.ndarray) -> bytes:
    """For each bit, the parity of the number of shingles that hash to it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 2 << (len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with ``size`` bytes: a position counts modulo the smaller number of bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=np.uint64).reshape(-1, size // 8), axis=0)


class Blocks:
    """Fingerprints of the occupied blocks of a set, for its own size band and, where needed, the next."""

    def __init__(self, similarity: float):
        t = Fraction(similarity).limit_denominator(1000)
        self.t, self.slack = t, (1 - t) / (1 + t)

    def most_different(self, size: int) -> int:
        """The largest symmetric difference of a set of this size and a similar one that is not larger."""
        return int(self.slack * 2 * size)

    def differing(self, size: int, band: int) -> int:
        """The largest symmetric difference of a set of this size and a similar one that it meets in the band."""
        return int(self.slack * (size + max(size, min(int(size / self.t), 2 ** (band + 1) - 1))))

    def count(self, band: int) -> int:
        """Blocks of a band (sizes 2**band to 2**(band+1)-1). Enough that a set leaves over D(size) of them occupied: the
        expectation is more than seven standard deviations above it at every size; small sets have a block for each shingle."""
        return 2**20 if band < 5 else int(1.2 * self.most_different(2 ** (band + 1) - 1)) + 24

    def bands(self, size: int) -> list[int]:
        band = size.bit_length() - 1
        return [band] + [band + 1] * (size >= self.t * 2 ** (band + 1))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """Hashes of the blocks; the last bit is that of the band's number."""
        if not self.most_different(int(len(shingles) / self.t)):
            return np.empty(0, dtype=np.uint64)  # only equal sets are similar
        out = []
        for band in self.bands(len(shingles)):
            k = np.uint64(self.count(band))
            block = ((shingles >> np.uint64(32)) * k) >> np.uint64(32)  # grows with the hash, so blocks are runs
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            bits = np.bitwise_xor.reduceat(_mix(shingles), first)
            own = _mix(bits ^ _mix(block[first] + (np.uint64(band) << np.uint64(40))))
            out.append(own >> np.uint64(1) << np.uint64(1) | np.uint64(band & 1))
        return np.concatenate(out)


def _fingerprints(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard number, then 31 further bits, then the last bit of the hash."""
    n, high = np.uint64(shards), hashes >> np.uint64(32)
    fine = (high * n + (((hashes & _LOW) * n) >> np.uint64(32))) & _LOW
    return ((high * n >> np.uint64(32)) << np.uint64(32)) | (fine >> np.uint64(1) << np.uint64(1)) | (hashes & np.uint64(1))


def _meeting(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by (sig, key) without repeats, and where each block starts and how many entries it has."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[new], key[new]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    return sig, key, first, np.diff(np.append(first, len(sig)))


def _stars(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distinct pairs of each block's least key with its others, from the sorted keys of blocks of these sizes."""
    inside = np.repeat(np.cumsum(size) - size, size)
    at = np.flatnonzero(inside != np.arange(len(key)))
    return np.unique(np.stack([key[inside[at]], key[at]], axis=1), axis=0)


_ROWS = "kind int, shard int, a long, b long, n_rows int, data binary, extra binary"


def _rows(kind: int, **columns) -> pd.DataFrame:
    """Rows of one kind: 0 block fingerprints of a shard; 1 a candidate pair (a, b), n_rows 1 if of a hot block; 2 the keys of
    classes that share the hot block a, in data; 3 a document: its class a, its number of shingles b, its id in data, its sketch
    in extra and its blocks to spare in n_rows; 4 an entry (a, b) of a hot block; 5 a class a of b shingles with too few blocks."""
    base = {"kind": kind, "shard": 0, "a": 0, "b": 0, "n_rows": 0, "data": None, "extra": None}
    return pd.DataFrame({**base, **columns}, index=range(len(next(iter(columns.values())))))


def _slices(batches: Iterator[pd.DataFrame], rows: int, size: int = 1 << 23, col: str = "t") -> Iterator[pd.DataFrame]:
    """The batches cut into slices of at most so many rows, and of so many bytes in ``col`` or one row's more."""
    for batch in batches:
        at = np.cumsum([0 if t is None else len(t) for t in batch[col].array]) // size
        cuts = {0, len(batch), *range(rows, len(batch), rows), *(np.flatnonzero(np.diff(at)) + 1).tolist()}
        cuts = sorted(cuts)
        yield from (batch.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


def _entries(texts: DataFrame, blocks: Blocks, width: int, shards: int, slice_rows: int = 4000) -> DataFrame:
    """From (id, t): documents and their block fingerprints by shard; of hot blocks, the pairs and members within a slice too.

    A fingerprint is cut to its shard and 32 further bits: as shards grow with the corpus, the blocks that meet by chance
    stay a small share, and their classes are not similar when verified.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles_of = shingles_of_width(width)
        for batch in _slices(batches, slice_rows):
            keys, sizes, sketches, sigs = [], [], [], {}
            for text in batch["t"].array:
                s = shingles_of(text)
                keys.append(set_key(s))
                sizes.append(len(s))
                sketches.append(parity_sketch(s) if len(s) else None)
                if len(s) and keys[-1] not in sigs:
                    sigs[keys[-1]] = blocks(s)
            size_of = dict(zip(keys, sizes, strict=True))
            known = sorted(sigs)  # a class goes by its place among the slice's until its key is shipped
            sig = np.concatenate([np.empty(0, dtype=np.uint64), *(sigs[k] for k in known)])
            key = np.repeat(np.arange(len(known), dtype=np.int32), [len(sigs[k]) for k in known])
            del sigs
            sig, key, first, size = _meeting(_fingerprints(sig, shards), key)
            many = np.bincount(2 * key + (sig & np.uint64(1)).astype(np.int64), minlength=2 * len(known)).tolist()
            key = np.array(known, dtype=np.int64)[key]
            spare, short = {}, []
            for k, counts in zip(known, zip(many[::2], many[1::2], strict=True), strict=True):
                n = size_of[k]
                spare[k], band = 0, n.bit_length() - 1
                for odd in (0, 1):
                    if counts[odd]:
                        left = counts[odd] - 1 - blocks.differing(n, band + ((band & 1) != odd))
                        if left < 0:
                            short.append((k, n))
                        spare[k] |= max(0, min(left, _MOST_SPARE)) << (15 * odd)
            yield _rows(3, a=keys, b=sizes, n_rows=[spare.get(k, 0) for k in keys], data=batch["id"].array, extra=sketches, shard=[k % shards for k in range(len(keys))])
            if short:
                yield _rows(5, a=[k for k, _ in short], b=[n for _, n in short])
            if not len(sig):
                continue
            hot = size > HOT
            if hot.any():
                inside = np.repeat(hot, size)
                of_hot, many = key[inside], size[hot]
                starts, pairs = np.cumsum(many) - many, _stars(of_hot, many)
                yield _rows(1, a=pairs[:, 0], b=pairs[:, 1], n_rows=1, shard=pairs[:, 1] % shards)
                ids = sig[first[hot]].astype(np.int64)
                yield _rows(2, a=ids, data=[of_hot[at : at + m].tobytes() for at, m in zip(starts, many, strict=True)], shard=ids % shards)
                yield _rows(4, a=ids, b=of_hot[starts], shard=ids >> 32)
                sig, key = sig[~inside], key[~inside]
            shard = (sig >> np.uint64(32)).astype(np.int64)
            cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
            rows = []
            for start, end in zip(cut, cut[1:], strict=False):
                own, place = np.unique(key[start:end], return_inverse=True)
                rows.append((shard[start], end - start, sig[start:end].astype(np.uint32).tobytes() + place.astype(np.uint16).tobytes(), own.tobytes()))
            if rows:
                shard, many, data, extra = map(list, zip(*rows, strict=True))
                yield _rows(0, shard=shard, n_rows=many, data=data, extra=extra)

    return texts.mapInPandas(giving_back(run), _ROWS)


def _shard(group: pd.DataFrame) -> pd.DataFrame:
    """What the blocks of a shard have in common, as pairs (kind 1) and members of hot blocks (kind 2); other rows pass."""
    blobs, hot = group[group["kind"] == 0], group[group["kind"] == 4]
    done = group[group["kind"].isin([1, 2, 3, 5])]
    if not len(blobs) and not len(hot):
        return done
    sigs, keys = [hot["a"].to_numpy().astype(np.uint32)], [hot["b"].to_numpy()]
    for many, data, extra in zip(blobs["n_rows"], blobs["data"], blobs["extra"], strict=True):
        sigs.append(np.frombuffer(data, dtype=np.uint32, count=many))
        keys.append(np.frombuffer(extra, dtype=np.int64)[np.frombuffer(data, dtype=np.uint16, offset=4 * many)])
    sig, key, first, size = _meeting(np.concatenate(sigs), np.concatenate(keys))
    common = (size > HOT) | np.isin(sig[first], sigs[0])
    out = [done] if len(done) else []
    for flag in (False, True):
        of = common == flag
        own, many = key[np.repeat(of, size)], size[of]
        pairs = _stars(own, many)
        if len(pairs):
            out.append(_rows(1, a=pairs[:, 0], b=pairs[:, 1], n_rows=int(flag)))
        if flag and len(own):
            ids = (np.int64(group["shard"].iloc[0]) << 32) | sig[first[of]].astype(np.int64)
            out.append(_rows(2, a=ids, data=[own[at : at + m].tobytes() for at, m in zip(np.cumsum(many) - many, many, strict=True)]))
    return pd.concat(out) if out else group.iloc[:0]


def _shard_then_trim(group: pd.DataFrame) -> pd.DataFrame:
    out = _shard(group)
    give_back()
    return out


def _texts_of(texts: DataFrame, wanted: DataFrame, buckets: int = 1 << 20) -> DataFrame:
    """``wanted`` rows with the text of their document ``rep``. Ids outside the buckets of those wanted (at most ``buckets``
    numbers, so small enough to broadcast) are left out before texts are shuffled; in a large corpus all may pass."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).alias("bucket")
    near = texts.select("*", bucket("id")).join(F.broadcast(wanted.select(bucket("rep")).distinct()), "bucket", "left_semi")
    return near.join(wanted, F.col("id").eqNullSafe(F.col("rep"))).drop("bucket", "id", "rep")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int, t: Fraction, most_members: int = 256) -> DataFrame:
    """Of distinct pairs (a, b) of keys those whose sets are similar, as (u, v).

    The texts of all b of one a meet its own text, in lots of about ``most_members``, sorted so that one is in memory at a
    time. Texts travel, as they are smaller than their sets.
    """
    lots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most_members).cast("int").alias("lots"))
    others = pairs.join(lots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), F.col("b").alias("key"), F.lit(1).alias("place"))
    own = lots.select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col("a").alias("key"), F.lit(0).alias("place"))
    wanted = checkpointed(own.unionByName(others).join(classes, "key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles_of, at, pivot = shingles_of_width(width), None, None
        for batch in batches:
            out = []
            for a, lot, key, place, text in zip(batch["a"].tolist(), batch["lot"].tolist(), batch["key"].tolist(), batch["place"].tolist(), batch["t"].array, strict=True):
                s = shingles_of(text)
                if set_key(s) != key:  # another row of a repeated id
                    continue
                if place == 0:
                    at, pivot = (a, lot), s
                elif at == (a, lot) and t.numerator * max(len(s), len(pivot)) <= t.denominator * min(len(s), len(pivot)):
                    both = len(s) + len(pivot) - len(np.union1d(s, pivot))
                    if both * t.denominator >= t.numerator * (len(s) + len(pivot) - both):
                        out.append((a, key))
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    met = _texts_of(texts, wanted).select("a", "lot", "key", "place", "t").repartition("a", "lot").sortWithinPartitions("a", "lot", "place")
    return met.mapInPandas(giving_back(run), "u long, v long").distinct()


def _possible(pairs: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) of keys that sizes and parity sketches do not rule out."""
    slack = (1 - t) / (1 + t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for na, nb, x, y in zip(batch["na"].tolist(), batch["nb"].tolist(), batch["sa"], batch["sb"], strict=True):
                size = min(len(x), len(y))
                ok.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)) * slack.denominator <= (na + nb) * slack.numerator)
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]]

    for own in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("key").alias(own), F.col("n").alias(f"n{own}"), F.col("sketch").alias(f"s{own}")), own)
    return pairs.filter(F.least("na", "nb") * t.denominator >= F.greatest("na", "nb") * t.numerator).mapInPandas(giving_back(run), "a long, b long")


def _grouped(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that are sorted by ``names``; a group may go on over batches."""
    held: list[pd.DataFrame] = []
    for batch in _with_end(batches):
        rows = pd.concat(held + ([batch] if batch is not None else []), ignore_index=True) if held or batch is not None else None
        held = []
        if rows is None or not len(rows):
            continue
        at = rows[names].to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        if batch is not None:
            held = [rows.iloc[cuts[-2] :]]
            cuts.pop()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield rows.iloc[a:b]


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _near(group: pd.DataFrame, sketches: list[bytes], t: Fraction) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a lot's first side the rows of the second (of the first, further on, where there is no second) that are
    in other components and that sizes and sketches allow, with the distances of the sketches."""
    slack = (1 - t) / (1 + t)
    length = np.array([len(s) for s in sketches])
    # two sketches are compared at the length of the shorter one
    at_length = {int(c): (np.cumsum(length >= c) - 1, np.stack([folded(s, int(c)) for s in sketches if len(s) >= c])) for c in np.unique(length)}
    n, label, side = (group[c].to_numpy() for c in ("n", "label", "side"))
    within = not side.any()
    right = np.flatnonzero(side != within)
    for i in np.flatnonzero(side == 0):
        at = right[(label[right] != label[i]) & (np.minimum(n[right], n[i]) * t.denominator >= np.maximum(n[right], n[i]) * t.numerator)]
        at = at[at > i] if within else at
        if not len(at):
            continue
        far, common = np.empty(len(at), dtype=np.int64), np.minimum(length[at], length[i])
        for c in np.unique(common):
            row, sk = at_length[int(c)]
            far[common == c] = np.bitwise_count(sk[row[at[common == c]]] ^ sk[row[i]]).sum(axis=1, dtype=np.int64)
        ok = far * slack.denominator <= (n[at] + n[i]) * slack.numerator
        if ok.any():
            yield i, at[ok], far[ok]


_LOT = ["grp", "x", "y"]


def _kruskal(label: list[int], i: np.ndarray, j: np.ndarray, far: np.ndarray, similar) -> Iterator[tuple[int, int]]:
    """Of the pairs (i, j), nearest first, those that join two components and are similar."""
    root = {x: x for x in label}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.argsort(far, kind="stable")
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        u, v = top(label[a]), top(label[b])
        if u != v and similar(a, b):
            root[u] = v
            yield a, b


def _listed(group: pd.DataFrame, sketches: list[bytes], t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [(np.full(len(at), i), at, far) for i, at, far in _near(group, sketches, t)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 3


def _undecided(t: Fraction):
    """Of the lots' classes those that sketches leave with a possible partner in another component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, _LOT):
            left: set[int] = set()
            for i, at, _ in _near(group, group["sketch"].tolist(), t):
                left.add(int(i))
                left.update(at.tolist())
            if left:
                yield group.iloc[sorted(left)][[*_LOT, "side", "key", "label"]]

    return giving_back(run)


def _joining(width: int, t: Fraction):
    """Links between components, at most one fewer than the classes of a lot: nearest sketches first, and only between
    components that earlier links of the lot have not joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles_of = shingles_of_width(width)
        for group in _grouped(batches, _LOT):
            sets = [shingles_of(x) for x in group["t"]]
            same = np.array([set_key(s) == k for s, k in zip(sets, group["key"].tolist(), strict=True)], dtype=bool)
            sets = [s for s, ok in zip(sets, same, strict=True) if ok]
            group = group[same].assign(n=[len(s) for s in sets])
            if len(sets) < 2:
                continue

            def similar(a: int, b: int, sets: list[np.ndarray] = sets) -> bool:
                both = len(sets[a]) + len(sets[b]) - len(np.union1d(sets[a], sets[b]))
                return both * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - both)

            key = group["key"].tolist()
            pairs = _kruskal(group["label"].tolist(), *_listed(group, [parity_sketch(s) for s in sets], t), similar)
            yield pd.DataFrame([(key[a], key[b]) for a, b in pairs], columns=["u", "v"]).astype("int64")

    return giving_back(run)


def _counted(packed: DataFrame) -> DataFrame:
    """Per hot block its number of entries m and the least key of all its members.

    ``packed``: block, data with some of its keys; a block that is hot in several slices, or in its shard too, has several such
    rows. Numbers and least keys are taken of them as they are.
    """

    def least_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"block": batch["block"], "least": [np.frombuffer(d, dtype=np.int64).min() for d in batch["data"]], "m": [len(d) // 8 for d in batch["data"]]})

    return packed.mapInPandas(least_of, "block long, least long, m long").groupBy("block").agg(F.min("least").alias("least"), F.sum("m").alias("m"))


def _members(packed: DataFrame) -> DataFrame:
    """The members (block, key) of ``packed`` hot blocks, listed one by one: what ``_held`` sums up."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[at : at + 256] for at in range(0, len(batch), 256)):
                many = [len(d) // 8 for d in part["data"]]
                each = {c: np.repeat(part[c].to_numpy(), many) for c in ("block", "least", "m")}
                yield pd.DataFrame({**each, "key": np.frombuffer(b"".join(part["data"]), dtype=np.int64)})

    return packed.join(_counted(packed), "block").select("block", "least", "m", "data").mapInPandas(unpack, "block long, least long, m long, key long").distinct()


def _held(packed: DataFrame, buckets: int) -> DataFrame:
    """Per group, bit of the band and class (grp, odd, key) the number n of the group's hot blocks that hold the class, and m, the
    entries of the largest of these blocks, the same for all classes.

    A class of a group mostly shares many of its blocks. Members are dealt to ``buckets`` by their keys in packed rows, so that
    a group of any size is spread, and are counted there without repeats.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches, 4000, col="data"):
            every = np.repeat(part["block"].to_numpy(), [len(d) // 8 for d in part["data"]])
            block, key, first, many = _meeting(every, np.frombuffer(b"".join(part["data"]), dtype=np.int64))
            of = part.drop_duplicates("block").set_index("block").loc[block[first]]
            order = np.argsort(key % buckets, kind="stable")
            rows = np.stack([block, np.repeat(of["grp"].to_numpy(), many), np.repeat(of["m"].to_numpy(), many), key])[:, order]
            cut = np.flatnonzero(np.diff(rows[3] % buckets, prepend=-1, append=-1)).tolist()
            yield pd.DataFrame({"bucket": rows[3][cut[:-1]] % buckets, "data": [rows[:, a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]})

    def count(bucket: pd.DataFrame) -> pd.DataFrame:
        block, grp, m, key = np.concatenate([np.frombuffer(d, dtype=np.int64).reshape(4, -1) for d in bucket["data"]], axis=1)
        rows = pd.DataFrame({"grp": grp, "odd": block & 1, "key": key, "m": m, "block": block}).drop_duplicates(["block", "key"])
        out = rows.groupby(["grp", "odd", "key", "m"], sort=False).size().rename("n").reset_index()
        give_back()
        return out[["grp", "odd", "key", "n", "m"]]

    # a group's blocks all hold its least key, so there are no more of them than one document has
    group = Window.partitionBy("least", F.col("block").bitwiseAND(F.lit(1)))
    blocks = _counted(packed).select("block", F.col("least").alias("grp"), F.max("m").over(group).alias("m"))
    dealt = packed.join(blocks, "block").select("block", "grp", "m", "data").mapInPandas(giving_back(deal), "bucket long, data binary")
    return dealt.groupBy("bucket").applyInPandas(count, "grp long, odd long, key long, n long, m long")


def _looked_at(held: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the classes ``_held`` by groups those that must meet there, as members (grp, key).

    The common order of hot blocks is that of their groups, the largest first. A class leaves out a group if the blocks it has
    there and in those before are no more than it has to spare.
    """
    spare = F.when(F.col("odd") == 1, F.shiftright("spare", 15)).otherwise(F.col("spare").bitwiseAND(F.lit(_MOST_SPARE)))
    upto = F.sum("n").over(Window.partitionBy("key", "odd").orderBy(F.desc("m"), F.desc("grp")))
    kept = held.join(classes.select("key", "spare"), "key").select("grp", "key", upto.alias("upto"), spare.alias("spare")).filter("upto > spare")
    return kept.select("grp", "key").distinct()


def _lots(members: DataFrame, classes: DataFrame, of_key: DataFrame, chunk: int, chunk_shingles: int) -> DataFrame:
    """The groups of several components in lots of two sides, each a chunk of the group's classes or, second, none.

    The classes of a group's largest component meet the others, chunk by chunk, and the others meet each other.
    """
    named = classes.select("key", "n").join(of_key, "key", "left").select("key", "n", F.coalesce("label", "key").alias("label"))
    marked = checkpointed(members.join(named, "key"))
    parts = marked.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    largest = F.max(F.struct("m", "label", "n"))
    groups = parts.groupBy("grp").agg(largest.alias("inner"), (F.sum("m") - largest["m"]).alias("m"), (F.sum("n") - largest["n"]).alias("n"), F.sum("m").alias("all"))
    chunks = lambda m, n: F.greatest(F.ceil(m / chunk), F.ceil(n / chunk_shingles)).cast("int")
    mixed = groups.filter("m > 0 and all > 2").select("grp", F.col("inner.label").alias("main"), chunks(F.col("inner.m"), F.col("inner.n")).alias("inside"), chunks(F.col("m"), F.col("n")).alias("outside"))
    spread = marked.join(mixed, "grp").join(classes.select("key", "sketch"), "key")
    lot = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    within = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    of_main = F.transform(every("outside"), lambda o: lot(-1 - within("inside"), o, F.lit(0)))
    with_main = F.transform(every("inside"), lambda i: lot(-1 - i, within("outside"), F.lit(1)))
    of_others = F.transform(every("outside"), lambda o: lot(F.least(within("outside"), o), F.greatest(within("outside"), o), within("outside") > o))
    lots = spread.select("grp", F.explode(F.when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(with_main, of_others))).alias("lot"), "key", "label", "n", "sketch")
    return lots.select("grp", "lot.*", "key", "label", "n", "sketch").repartition(*_LOT).sortWithinPartitions(*_LOT)


def _joined(of_key: DataFrame, links: DataFrame) -> DataFrame:
    """(key, label) of the components after further links (u, v)."""
    ends = links.join(of_key.select(F.col("key").alias("u"), F.col("label").alias("lu")), "u", "left").join(of_key.select(F.col("key").alias("v"), F.col("label").alias("lv")), "v", "left")
    top = connected_components(ends.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))
    top = checkpointed(top.select(F.col("node").alias("label"), F.col("label").alias("top")))
    known = of_key.select("key", "label").unionByName(top.select(F.col("label").alias("key"), "label")).distinct().join(top, "label", "left")
    return checkpointed(known.groupBy("key").agg(F.min(F.coalesce("top", "label")).alias("label")))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, width: int = 5, entries_per_shard: int = 1_000_000, chunk: int = 1024, chunk_shingles: int = 2_000_000) -> DataFrame:
    """Per row: id_col, n_shingles, class_key (of its shingle set) and component_id, the smallest id reachable by links.

    Sets are those of the distinct ``width``-word shingles of the whole lower-cased (A-Z) text; a text of fewer words is one
    shingle. Null and wordless texts have an empty set (n_shingles 0) and are linked with nothing, so their component is
    their own id. Repeated rows and ids are kept row by row, null ids too (a null component only where no other id is
    reachable); an empty table gives no rows; columns other than the two named are not read. Ids may have any type that a
    string holds without loss. ``chunk`` and ``chunk_shingles`` bound what a lot of an exhaustive comparison holds at once.
    """
    blocks = Blocks(similarity)
    id_type = df.schema[id_col].dataType
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    # about an entry for every 8 bytes of text
    bytes_ = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(64, bytes_ // 8 // entries_per_shard)
    as_bytes = texts.select(F.col("id").cast("string").cast("binary").alias("id"), "t")
    found = _entries(as_bytes, blocks, width, shards).repartition(max(min(shards, 2000), shards // 64), "shard").groupBy("shard").applyInPandas(_shard_then_trim, _ROWS)
    found = checkpointed(found.select("kind", "a", "b", "n_rows", "data", F.when(F.col("kind") == 3, F.col("extra")).alias("sketch")))
    rows = found.filter("kind = 3").select(F.col("data").cast("string").cast(id_type).alias("id"), F.col("b").alias("n"), F.col("a").alias("key"), "sketch", F.col("n_rows").alias("spare"))
    classes = checkpointed(rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sketch", "spare"))))
    reps = classes.select("key", "rep")
    pairs = found.filter("kind = 1").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("n_rows").alias("hot"))
    short = found.filter("kind = 5").select(F.col("a").alias("short"), F.col("b").alias("m")).distinct()
    if not short.isEmpty():  # hardly ever: classes of too few blocks are paired with all that sizes and sketches allow
        size = F.col("n") * blocks.t.numerator <= F.col("m") * blocks.t.denominator
        others = classes.join(short, size & (F.col("m") * blocks.t.numerator <= F.col("n") * blocks.t.denominator) & (F.col("key") != F.col("short")))
        pairs = pairs.unionByName(others.select(F.least("key", "short").alias("a"), F.greatest("key", "short").alias("b"), F.lit(1).alias("hot")).distinct())
    pairs = checkpointed(pairs)

    links = checkpointed(_verified(checkpointed(_possible(pairs.select("a", "b"), classes, blocks.t)), texts, reps, width, blocks.t))
    of_key = checkpointed(connected_components(links)).withColumnRenamed("node", "key")
    held = _held(found.filter("kind = 2").select(F.col("a").alias("block"), "data").distinct(), shards)
    own = pairs.filter("hot = 0").select(F.col("a").alias("grp"), F.explode(F.array("a", "b")).alias("key"))
    members = checkpointed(own.unionByName(_looked_at(held, classes)).distinct())

    lots = _lots(members, classes, of_key, chunk, chunk_shingles)
    left = checkpointed(lots.mapInPandas(_undecided(blocks.t), "grp long, x int, y int, side int, key long, label long").join(reps, "key"))
    more = _texts_of(texts, left).select(*_LOT, "side", "key", "label", "t").repartition(*_LOT).sortWithinPartitions(*_LOT, "key")
    more = checkpointed(more.mapInPandas(_joining(width, blocks.t), "u long, v long").distinct())
    if not more.isEmpty():
        of_key = _joined(of_key, more)
    named = checkpointed(classes.join(of_key, "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label")))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    by_key = named.join(least, "label").select("key", "component")
    out = rows.withColumn("key", F.when(F.col("n") > 0, F.col("key"))).join(by_key, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def _repeated(rows: DataFrame) -> bool:
    """Whether some id occurs twice (a set may then be read twice)."""
    return not rows.groupBy("id").count().filter("count > 1").isEmpty()


def drop_similar(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``df`` with one document of each component: that with the smallest id.

    Rows that share an id stay or go together; of those that stay, rows of equal texts are reduced to one.
    """
    linked = similar_components(df, id_col, **options)
    kept = linked.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col).distinct()
    name = free_name(df, "kept_id")
    kept = df.join(kept.withColumnRenamed(id_col, name), F.col(id_col).eqNullSafe(F.col(name))).drop(name)
    return kept.dropDuplicates([id_col, options.get("text_col", "text")]) if _repeated(df.select(F.col(id_col).alias("id"))) else kept
