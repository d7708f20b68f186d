"""Text that was decoded with the wrong character encoding."""

from __future__ import annotations

import codecs
import re
from bisect import bisect_right
from collections.abc import Iterator
from copy import copy
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.windows import distinct

LOST = "�"
RUN = re.compile(r"[^\x00-\x7f]+")
#: Encodings of one byte a character, of which each may have been taken for any other, or for which UTF-8 was taken.
BYTE = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman")
#: Encodings of several bytes a character, which were taken for one of BYTE.
WIDE = ("euc_jp", "cp932")
#: Control characters, which stand between two wrong readings.
CONTROL = range(0x80, 0xA0)
#: Natural logarithms of the odds by which a mapping must make a text more probable.
LEAST = 5.0
#: The same where nothing but the odds speak for a mapping: a byte of one encoding is a valid byte of another.
LEAST_BYTE = 9.0
#: Logarithms of a pair's information below which it is improbable: a loose one where UTF-8 is tried, whose bytes are seldom valid by
#: chance (wrong readings can be common in a corpus), and a strict one where only the odds speak.
USUAL, RARE = float(np.log(0.15)), float(np.log(2e-3))
#: What a decoded sequence of UTF-8 bytes adds, as few sequences of such bytes are valid.
VALID = 2.5
#: What is taken off once where a reading has characters of two bytes that no text has: such bytes may be valid by chance, and the corpus says nothing of them.
DOUBT = 6.0
#: Parts of the collection by hash of the group: a text is also judged without the part that its group is in, so there is one more table of pairs for each.
FOLDS = 16


# --- the alphabet of the statistics: its size is fixed, so the table of pairs has a fixed bound ---------------------


def _class_ranges() -> list[tuple[int, int, int]]:
    """(from, to, characters in a class): letters and signs that wrong decoding yields have a class each, the rest share one."""
    return [(0, 0x590, 1), (0x590, 0x2000, 64), (0x2000, 0x2070, 1), (0x2070, 0x20A0, 8), (0x20A0, 0x20D0, 1), (0x20D0, 0x2100, 8), (0x2100, 0x2300, 1), (0x2300, 0x2500, 8), (0x2500, 0x2600, 1), (0x2600, 0x3000, 64), (0x3000, 0x3100, 1), (0x3100, 0x4E00, 256), (0x4E00, 0xA000, 64), (0xA000, 0xF000, 1024), (0xF000, 0xFF00, 64), (0xFF00, 0x10000, 1), (0x10000, 0x110000, 65536)]


@cache
def class_table() -> tuple[np.ndarray, int]:
    """The class of every code point (of its lower case), and the number of classes."""
    plain, n = np.zeros(0x110000, np.int32), 0
    for a, z, step in _class_ranges():
        plain[a:z] = n + (np.arange(z - a) // step)
        n += -(-(z - a) // step)
    out = plain.copy()
    for c in range(0x80, 0x2C00):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = plain[ord(low)]
    for c in range(ord("A"), ord("Z") + 1):
        out[c] = plain[c + 32]
    out[ord("0") : ord("9") + 1] = plain[ord("0")]
    return out, n


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def classes(text: str) -> np.ndarray:
    return class_table()[0][codes(text)]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts with a line break before, between and after, and the text that each place belongs to."""
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    return classes("\n" + "\n".join(texts) + "\n"), np.concatenate([[0], owner])


def _fold(group: str) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(FOLDS)).cast("int")


def _distinct_texts(df: DataFrame, text: str, group: str | None) -> DataFrame:
    """(x, folds): every different text once, null if it is ASCII, with the set of folds that its copies' groups are in as bits. Copies are told by a hash of 128 bits and dropped map-side first."""
    bit = F.lit(0) if group is None else F.when(F.col(group).isNotNull(), F.call_function("shiftleft", F.lit(1), _fold(group))).otherwise(0)
    src = df.where(F.length(text) > 0).select(F.md5(F.col(text).cast("binary")).alias("h"), F.when(F.col(text).rlike(r"[^\x00-\x7f]"), F.col(text)).alias("x"), bit.cast("long").alias("folds"))
    return src.groupBy("h").agg(F.first("x").alias("x"), F.bit_or("folds").alias("folds")).select("x", "folds")


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def lost_characters(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id): records whose text has a character that stands for one that was lost (U+FFFD), which no method can restore. Null and empty texts have none."""
    return df.where(F.contains(F.col(text), F.lit(LOST))).select(F.col(id_col).cast("long").alias("id"))


def pair_statistics(df: DataFrame, text: str, group: str | None = None) -> DataFrame:
    """(f, a, b, n): in how many different texts class a stands before class b, for pairs that aren't both ASCII; with b = -1, how many texts have class a, and with a = b = -1 how many there are. f = -1: of all texts; else of those that a group of fold f has. At most (FOLDS + 1) times (number of classes + 1) squared rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = class_table()[1]
        size = k * (k + 1)
        keys, counts, n_texts = [], [], np.zeros(FOLDS + 1, np.int64)
        for batch in batches:
            folds = batch.column(1).to_numpy()
            member = np.stack([np.ones(len(folds), bool), *[(folds >> f) & 1 > 0 for f in range(FOLDS)]])
            n_texts += member.sum(1)
            texts = batch.column(0).to_pylist()
            member = member[:, [t is not None for t in texts]]
            texts = [t for t in texts if t is not None]
            if not texts:
                continue
            c, owner = _joined(texts)
            wide = c >= 128
            at = np.flatnonzero(wide[1:] | wide[:-1])
            pair = c[at].astype(np.int64) * k + c[at + 1]
            single = np.flatnonzero(wide)
            key = np.concatenate([distinct(owner[at] * size + pair), distinct(owner[single] * size + k * k + c[single])])
            owner, key = key // size, key % size
            for f, mine in enumerate(member):
                u, n = np.unique(key[mine[owner]], return_counts=True)
                keys.append(f * size + u)
                counts.append(n)
            if len(keys) > 64 * (FOLDS + 1):  # merged as they come, so no more is held than there are different pairs
                keys, counts = ([v] for v in _added(keys, counts))
        if keys:
            u, n = _added(keys, counts)
            f, u = u // size, u % size
            single = u >= k * k
            yield pa.RecordBatch.from_arrays([pa.array((f - 1).astype(np.int32)), pa.array(np.where(single, u - k * k, u // k).astype(np.int32)), pa.array(np.where(single, -1, u % k).astype(np.int32)), pa.array(n)], ["f", "a", "b", "n"])
        none = pa.array(np.full(FOLDS + 1, -1, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FOLDS, dtype=np.int32)), none, none, pa.array(n_texts)], ["f", "a", "b", "n"])

    return _distinct_texts(df, text, group).mapInArrow(run, "f int, a int, b int, n long").groupBy("f", "a", "b").agg(F.sum("n").alias("n"))


class Model:
    """What the corpus says about pairs of neighbouring characters. own: how many of the counted texts are the one in question."""

    own = 1

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray):
        k = class_table()[1]
        self.k, self.total = k, float(n[(a == -1) & (b == -1)].sum())
        single = (b == -1) & (a >= 0)
        self.of = np.full(k, self.total)  # an ASCII character is taken to be in every text
        self.of[128:] = 0
        self.of[a[single]] = n[single]
        pair = b >= 0
        key = a[pair].astype(np.int64) * k + b[pair]
        order = np.argsort(key)
        self.key, self.n = key[order], n[pair][order].astype(np.float64)

    def without(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Model:
        """The same with pairs as they stand in texts of other groups only. Characters keep their counts, so a script that one group alone has isn't strange."""
        out = copy(self)
        pair = b >= 0
        out.own, out.n = 0, self.n.copy()
        out.n[np.searchsorted(self.key, a[pair].astype(np.int64) * self.k + b[pair])] -= n[pair]
        return out

    def known(self, texts: list[str]) -> bool:
        """Does at least half of the pairs in these texts stand in others?"""
        c = [classes(t) for t in texts]
        a, b = np.concatenate([x[:-1] for x in c]), np.concatenate([x[1:] for x in c])
        wide = (a >= 128) | (b >= 128)
        return bool(wide.any()) and float((self.count(a[wide], b[wide]) > 0).mean()) >= 0.5

    def count(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many other texts have the pair (the one in question has it as well)."""
        if not len(self.key):
            return np.zeros(len(a))
        key = a.astype(np.int64) * self.k + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, np.maximum(self.n[at] - self.own, 0), 0)

    def log_odds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log P(b after a), from texts. Pairs of ASCII characters count 0, as every mapping leaves them."""
        prior = 0.02 * (self.of[b] + 0.05) / (self.total + 1)
        p = np.log((self.count(a, b) + prior) / (self.of[a] + 1))
        return np.where((a < 128) & (b < 128), 0.0, p)

    def information(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Logarithm of a pair's part in the mutual information of neighbours, P(ab) log(P(ab) / (P(a) P(b))): small for rare pairs and for pairs that meet by chance."""
        joint = self.count(a, b) / (self.total + 1)
        chance = self.of[a] * self.of[b] / (self.total + 1) ** 2
        part = joint * np.maximum(np.log((joint + 1e-12) / (chance + 1e-12)), 0.2)
        return np.log(part + 1e-6)


def improbable_runs(score: np.ndarray, place: np.ndarray, gap: float = 0.4) -> list[tuple[int, int]]:
    """Maximum-scoring segments: disjoint ranges of places whose scores add up to more than any longer or shorter range around them has.

    score: of the pairs that aren't both ASCII; place: where each stands. Every ASCII pair between two of them costs ``gap``.
    """
    out, total, best, start, end = [], 0.0, 0.0, 0, 0
    last = None
    for s, p in zip(score.tolist(), place.tolist(), strict=True):
        if last is not None:
            total -= gap * (p - last - 1)
        if total <= 0 or (best > 0 and best - total > 12):
            if best > 2:
                out.append((start, end))
            total, best, start = 0.0, 0.0, p
        total += s
        if total > best:
            best, end = total, p + 2
        last = p
    if best > 2:
        out.append((start, end))
    return out


def _within(segments: list[tuple[int, int]], starts: list[int], a: int, z: int) -> bool:
    """Does [a, z) meet one of the segments, which are in order and begin at starts?"""
    i = bisect_right(starts, z - 1) - 1
    return i >= 0 and segments[i][1] > a


# --- inverse mappings -----------------------------------------------------------------------------------------------


@cache
def byte_table(encoding: str) -> tuple[np.ndarray, dict[int, str]]:
    """Byte of each character (code points below 65536, -1: none) and character of each byte. Bytes without a character stand for the control character of the same number, as browsers have it."""
    of, char = np.full(65536, -1, np.int16), {}
    for byte in range(256):
        try:
            c = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(byte)
        char[byte] = c
        if len(c) == 1 and ord(c) < 65536:
            of[ord(c)] = byte
    if encoding != "latin_1":
        for byte in range(128, 160):
            if of[byte] < 0:
                of[byte] = byte
    return of, char


@cache
def byte_of(encoding: str) -> dict[int, int]:
    """Byte of each code point that has one."""
    of = byte_table(encoding)[0]
    return {int(c): int(of[c]) for c in np.flatnonzero(of >= 0)}


def encode(text: str, encoding: str) -> bytes | None:
    """The bytes that were read as ``text`` under ``encoding``; None if they can't have been."""
    if encoding in WIDE:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    try:
        return codecs.charmap_encode(text, "strict", byte_of(encoding))[0]
    except UnicodeEncodeError:
        return None


@cache
def byte_to_byte() -> tuple[list[tuple[str, str]], np.ndarray]:
    """Pairs (taken for, was) of different byte encodings, and for each a table of code points below 65536: what the character was, or 0 if it isn't there."""
    names, tables = [], []
    for x in BYTE:
        for y in BYTE:
            if x != y and not (x == "latin_1" and y == "cp1252"):
                was = np.zeros(256, np.uint16)
                for b, c in byte_table(y)[1].items():
                    was[b] = ord(c) if len(c) == 1 and not 128 <= ord(c) < 160 else 0
                of = byte_table(x)[0]
                t = np.where(of >= 0, was[np.maximum(of, 0)], 0).astype(np.uint16)
                names.append((x, y))
                tables.append(t)
    return names, np.stack(tables)


def undo_utf8(run: str, encoding: str) -> str | None:
    """What a run of characters was, if its bytes were UTF-8 and it was read as ``encoding``. A broken sequence at either end, cut off by a lost character, is left as it is."""
    raw = encode(run, encoding)
    if raw is None or len(raw) < 2:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


class Fixer:
    """Finds garbled runs of a text and what they were."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict = {}

    def gain(self, before: str, old: str, new: str, after: str) -> float:
        """log odds of new in place of old, between the characters around it."""
        x, y = classes(before + old + after), classes(before + new + after)
        return float(self.model.log_odds(y[:-1], y[1:]).sum() - self.model.log_odds(x[:-1], x[1:]).sum())

    def strange(self, text: str) -> bool:
        """Does it have a character of two bytes that no text of the corpus has? Two bytes are often valid by chance; three and four are not."""
        return any(0x80 <= ord(c) < 0x800 and ord(c) not in CONTROL and not self.model.of[class_table()[0][ord(c)]] for c in text)

    def utf8(self, before: str, run: str, after: str) -> tuple[tuple[float, str, str] | None, tuple[float, str, str] | None]:
        """The best undoing of one or more wrong readings of UTF-8: (gain, text, encodings), and the best of those that yield characters which no text has."""
        key = (before, run, after)
        if key in self.memo:
            return self.memo[key]
        best, strange, level = None, None, [(run, "", 0)]
        for _ in range(3):
            found = []
            for now, how, valid in level:
                for encoding in (*BYTE, "cp932"):
                    new = undo_utf8(now, encoding)
                    if new is None or new == now or LOST in new:
                        continue
                    wide = sum(ord(c) > 127 for c in new)
                    n = valid + wide
                    g = self.gain(before, run, new, after) + VALID * n
                    found.append((new, f"{how} {encoding}".strip(), n))
                    if self.strange(new):
                        # the odds of what no text has say nothing; of several such readings the more probable one
                        if strange is None or (n, g) > strange[0]:
                            strange = (n, g), (VALID * n - DOUBT, new, found[-1][1])
                    elif best is None or g > best[0] + 1e-6:
                        best = (g, new, found[-1][1])
            level = list({f[0]: f for f in found}.values())
            if not level:
                break
        best = best, strange and strange[1]
        if len(self.memo) > 100_000:
            self.memo.clear()
        self.memo[key] = best
        return best

    def examine(self, text: str) -> tuple[bool, bool, str, str | None, float]:
        """(garbled, lost, text with what could be restored, encodings, gain)."""
        lost = LOST in text
        if text.isascii():
            return False, False, text, None, 0.0
        c = np.concatenate([[10], classes(text), [10]])
        wide = c >= 128
        at = np.flatnonzero(wide[1:] | wide[:-1])
        score = USUAL - self.model.information(c[at], c[at + 1])
        segments = improbable_runs(np.clip(score, -4, 4), at) if (score > 0).any() else []
        if not segments and not lost:
            return False, False, text, None, 0.0
        starts = [s[0] for s in segments]
        padded = f"\n{text}\n"
        runs: dict[tuple[str, str, str], list[tuple[int, int]]] = {}
        for m in RUN.finditer(padded):
            if _within(segments, starts, m.start(), m.end()):
                # a lost character cuts a run in parts; each is tried alone
                a = m.start()
                for piece in m[0].split(LOST):
                    if piece:
                        runs.setdefault((padded[a - 1], piece, padded[a + len(piece)]), []).append((a, a + len(piece)))
                    a += len(piece) + 1
        edits: list[tuple[int, int, str]] = []
        total, names = 0.0, {}
        rest, doubtful = [], {}
        for key, places in runs.items():
            r, strange = self.utf8(*key)
            if r and r[0] >= 1.0:
                total += r[0] * len(places)
                names[r[2]] = names.get(r[2], 0.0) + r[0] * len(places)
                edits += [(a, z, r[1]) for a, z in places]
            else:
                rest.append((key, places))
                if strange:
                    doubtful.setdefault(strange[2], []).append((key, places, strange))
        # characters that no text has: all such runs that one reading undoes bear each other out, each different one once; those it leaves speak against it
        for name, those in doubtful.items():
            different = {key[1]: r[0] + DOUBT for key, _, r in those}
            left = {key[1] for key, _ in rest} - set(different)
            g = sum(different.values()) - VALID * len(left) - (0 if names.get(name, 0.0) >= LEAST else DOUBT)
            if g >= (0 if name in names else LEAST):
                total += g
                names[name] = names.get(name, 0.0) + g
                edits += [(a, z, r[1]) for _, places, r in those for a, z in places]
                taken = {key for key, _, _ in those}
                rest = [(k, p) for k, p in rest if k not in taken]
        how = None
        if total >= LEAST:
            how = "utf_8 as " + max(names, key=names.get)
        else:
            edits, total = [], 0.0
            rest = list(runs.items())
        score += RARE - USUAL
        segments = improbable_runs(np.clip(score, -4, 4), at) if (score > 0).any() else []
        starts = [s[0] for s in segments]
        rest = [(k, p) for k, p in rest if any(_within(segments, starts, a, z) for a, z in p)]
        if rest:
            more = self.other(padded, rest, segments)
            if more:
                total += more[0]
                edits += more[1]
                how = how or more[2]
        found = how is not None
        if found and not self.model.own:
            # where a group has texts of a kind that no other has, any reading of them is as improbable
            found = self.model.known([padded[a - 1] + new + padded[z : z + 1] for a, z, new in edits])
        if not found:
            how, total = None, 0.0
        if found:
            out, last = [], 0
            for a, z, new in sorted(edits):
                if a >= last:
                    out += [padded[last:a], new]
                    last = z
            text = "".join([*out, padded[last:]])[1:-1]
        return found or lost, lost, text, how, total

    def wide(self, padded: str, lo: int, hi: int, x: str, y: str) -> tuple[float, int, int, str] | None:
        """(gain, from, to, text) of undoing y read as x between the first and the last character of a range that aren't ASCII; None if there is no gain. The last one's second byte may be an ASCII character after it."""
        while lo < hi and ord(padded[lo]) < 128:
            lo += 1
        while hi > lo and ord(padded[hi - 1]) < 128:
            hi -= 1
        if hi - lo < 4:
            return None
        raw = encode(padded[lo:hi], x)
        if raw is None:
            return None
        try:
            new = raw.decode(y)
        except UnicodeDecodeError:
            try:
                new = (raw + padded[hi].encode()).decode(y)
                hi += 1
            except UnicodeError:
                return None
        g = self.gain(padded[lo - 1], padded[lo:hi], new, padded[hi] if hi < len(padded) else "\n")
        return (g, lo, hi, new) if g > 1.0 else None

    def other(self, padded: str, runs: list, segments: list[tuple[int, int]]) -> tuple[float, list, str] | None:
        """The best undoing of one byte encoding read as another, or of a wide one read as a byte encoding."""
        best = None
        # all runs in one array, with the characters around them
        parts = [codes(before + run + after) for (before, run, after), _ in runs]
        flat = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        table = class_table()[0]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        old = table[flat]
        old_ll = np.bincount(owner[inner], weights=self.model.log_odds(old[inner], old[inner + 1]), minlength=len(parts))
        names, maps = byte_to_byte()
        high = flat >= 128
        used, at = np.unique(np.minimum(flat[high], 65535), return_inverse=True)
        # mappings that do the same to these characters are tried once, the first of them; those that change nothing aren't
        to = maps[:, used]
        _, first = np.unique(to, axis=0, return_index=True)
        for j in np.sort(first):
            (x, y), new = names[j], flat.copy()
            if (to[j] == used).all():
                continue
            new[high] = to[j][at]
            bad = np.zeros(len(parts), bool)
            bad[owner[new == 0]] = True
            if bad.all():
                continue
            c = table[new]
            ll = np.bincount(owner[inner], weights=self.model.log_odds(c[inner], c[inner + 1]), minlength=len(parts))
            g = np.where(bad, 0, ll - old_ll)
            take = g > 1.0
            total = float(np.minimum(g, 20)[take].sum())  # each different run once: a repeated one says no more
            if total >= LEAST_BYTE and (best is None or total > best[0]):
                chosen = np.flatnonzero(take)
                best = (total, (chosen, new), f"{y} as {x}")
        edits = []
        if best:
            chosen, new = best[1]
            ends = np.cumsum([len(p) for p in parts])
            for i in chosen:
                text = "".join(map(chr, new[ends[i] - len(parts[i]) : ends[i]]))[1:-1]
                edits += [(a, z, text) for a, z in runs[i][1]]
            best = (best[0], edits, best[2])
        # wide encodings: lines that meet a segment, as their bytes may be ASCII; of a line that isn't wholly of such bytes the segment
        ends = [i for i, ch in enumerate(padded) if ch == "\n"]
        lines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, z in segments:
            for i in range(max(bisect_right(ends, a) - 1, 0), len(ends) - 1):
                if ends[i] >= z:
                    break
                lines.setdefault((ends[i] + 1, ends[i + 1]), []).append((max(a, ends[i] + 1), min(z, ends[i + 1])))
        for x in BYTE:
            for y in WIDE:
                total, edits = 0.0, []
                for line, inside in lines.items():
                    whole = self.wide(padded, *line, x, y)
                    for r in [whole] if whole else [self.wide(padded, a, z, x, y) for a, z in inside]:
                        if r:
                            total += r[0]
                            edits.append(r[1:])
                if total >= LEAST_BYTE and (best is None or total > best[0]):
                    best = (total, edits, f"{y} as {x}")
        return best


def garbled(df: DataFrame, id_col: str, text: str, group: str | None = None) -> DataFrame:
    """(id, lost, restored, how): every record whose text is garbled, wholly or in part.

    The corpus is read twice. First the pairs of neighbouring characters are counted over all different texts (in how many
    each stands, so that one long text weighs no more than a short one, and copies no more than one). Then each text's pairs are scored by their part
    in the mutual information of neighbours, without what the text itself adds; maximum-scoring segments of improbable
    pairs are cut out, and only inside them the inverse of each wrong reading is tried: UTF-8 read as another encoding,
    up to three times over; one byte encoding read as another; Japanese encodings read as a byte encoding. A reading is taken
    if it makes the text much more probable. Text in a rare script or with rare signs is improbable too, but no inverse
    makes it more probable. Characters of two bytes that no text has are restored where enough different runs of the text
    are valid under the same reading, as then only that speaks for them.

    group: a column of what was read together, such as a repo. Where all of a group was garbled in one way, its own texts
    would make the wrong pairs usual; so each text is examined a second time by the pairs of other groups' texts (of all
    that aren't in its fold, by hash of the group). What is found by these alone must restore pairs that other groups have.

    restored: the text with each such run replaced; lost: characters were replaced by U+FFFD for good, which is a case by
    itself and may leave nothing to restore. how: the encodings, null if only characters were lost. The table of pairs
    is broadcast; characters are put in a fixed number of classes, so it has a fixed bound however large the collection.

    Null, empty and ASCII texts are never cases. Copies of a text are each examined. An empty table gives no rows.
    """
    found = pair_statistics(df, text, group).toArrow()
    fold, *columns = (found.column(c).to_numpy() for c in ("f", "a", "b", "n"))
    tables = df.sparkSession.sparkContext.broadcast([[c[fold == f] for c in columns] for f in range(-1, FOLDS)])
    g = F.lit(None).cast("int") if group is None else F.when(F.col(group).isNotNull(), _fold(group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*tables.value[0])
        fixer = Fixer(model)
        others: dict[int, Fixer] = {}
        for b in batches:
            out = []
            for i, t, f in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                t = t.as_py()
                if t and not t.isascii():
                    yes, lost, new, how, _ = fixer.examine(t)
                    if f is not None:
                        if f not in others:
                            others[f] = Fixer(model.without(*tables.value[f + 1]))
                        also, _, new, more, _ = others[f].examine(new)
                        yes, how = yes or also, how or more
                    if yes:
                        out.append((i, lost, new, how))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["id", "lost", "restored", "how"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("x"), g.alias("f")).mapInArrow(run, "id long, lost boolean, restored string, how string")
