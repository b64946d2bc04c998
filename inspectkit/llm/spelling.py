"""Spelling variant grouping by a frequency-vector trie.

A word's vector counts its letters by group (code point modulo ``GROUPS``).
Words are arranged in a trie by the counts of successive groups.  An edit of
one letter raises the count of one group by one at most, and lowers that of
one group by one at most; so a depth-first search with a budget of one surplus
and one deficit reaches the leaves of all words within one edit.  The words of
these leaves are verified: with a common beginning of p and a common end of s
letters, two different words are one edit apart if p + s >= longest - 1.

Plan.  Occurrences are counted per task first.  The trie is cut into subtries
by the counts of its first levels; a word goes to its own subtrie, and as a
question there and to those that the budget reaches by a surplus first (10 for
four levels): of two words in different subtries one meets the other, and both
get to know.  How many levels: as few as leave ``SUBTRIE`` words at most in any one; a class that no
level divides (the words of one full vector) is cut into parts, each asked by
all.  A task holds one subtrie at a time and takes the questions in chunks,
each chunk's search carried down as arrays.  What it returns is one row for a
word and subtrie: number of near words and the best of them.  Forms are followed
from the roots outwards, a round for each step: a form has few near words, so
no join key is hot, and each step doubles the occurrences at least, so there
are log2 of the largest count at most.

Defined cases.  Null texts have no words; a null doc_id counts as an empty one.
Repeated rows count as often as they are.  Ties of the best near word go to the
smaller in code-point order.  Words have any length.  An empty table gives an
empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.llm import corpus as C

DAMAGE = 97
MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
GROUPS = 16
#: Levels of the trie: groups of frequent letters first, so that the first levels divide most.
ORDER = (5, 1, 9, 14, 15, 2, 3, 4, 12, 8, 13, 7, 6, 0, 11, 10)
SUBTRIE = 20_000
CHUNK = 4_000  # questions
PAIRS = 40_000  # pairs verified at a time
WIDE = 64  # letters; longer words are verified one by one
HELD = 300_000  # words counted before a task hands them on


def count_words(docs: DataFrame, damage: int = DAMAGE, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z lower-cased, of at least
    ``min_letters``.  ``damage`` > 0: where it divides the CRC-32 h of
    "doc_id:run", the run's letter h % length is left out first."""
    run_of = re.compile("[a-zÀ-ÿ]{%d,}" % min_letters)

    def rows(total: Counter) -> pa.RecordBatch:
        words = [w for w, n in total.items() if n and len(w) >= min_letters]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])

    def run(batches):
        total = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = run_of.findall(text.as_py().encode().lower().decode())  # bytes lower A-Z only
                total.update(found)
                if damage:
                    start = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                    hashes = [(zlib.crc32(w.encode(), start), w) for w in set(found)]
                    hit = {w: h for h, w in hashes if not h % damage}
                    if hit:
                        for w, n in Counter(w for w in found if w in hit).items():
                            k = hit[w] % len(w)
                            total[w] -= n
                            total[w[:k] + w[k + 1 :]] += n
                if len(total) > HELD:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    return C.texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, length of each)."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def vectors(words: list[str]) -> np.ndarray:
    """Letters of each word by group, in the order of the trie's levels."""
    codes, size = codes_of(words)
    place = np.argsort(ORDER)[codes % GROUPS]
    at = np.repeat(np.arange(len(words)), size) * GROUPS + place
    return np.bincount(at, minlength=len(words) * GROUPS).reshape(len(words), GROUPS).astype(np.int32)


def paths(v: np.ndarray) -> list[np.ndarray]:
    """Key of each word's path after 1, 2 ... levels of the trie."""
    key, out = np.zeros(len(v), np.uint64), []
    for level in range(v.shape[1]):
        key = A.mix(A.joined(key, v[:, level].astype(np.uint64) + np.uint64(1)))
        out.append(key)
    return out


def reach(v: np.ndarray, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, path keys, own path?) of what a surplus and a deficit of one can
    reach: each word's own path, and of the others those that differ by the
    surplus first.  Of two words on different paths, one finds the other."""
    v = v[:, :levels]
    yield np.arange(len(v)), paths(v)[-1], True
    for up in range(levels):
        for down in (-1, *range(up + 1, levels)):
            rows = np.flatnonzero(v[:, down] > 0) if down >= 0 else np.arange(len(v))
            w = v[rows].copy()
            w[:, up] += 1
            if down >= 0:
                w[:, down] -= 1
            yield rows, paths(w)[-1], False


def _levels(words: DataFrame) -> tuple[int, int]:
    """(levels that divide the words into subtries, parts of a subtrie)."""

    def run(batches):
        for b in batches:
            for level, key in enumerate(paths(vectors(b.column(0).to_pylist()))):
                keys, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), level + 1)), pa.array(keys.view(np.int64)), pa.array(n)], names=["level", "key", "n"])

    sizes = words.select("word").mapInArrow(run, "level long, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n"))
    most = {r.level: r.n for r in sizes.groupBy("level").agg(F.max("n").alias("n")).collect()}
    for level in range(1, GROUPS):
        if most.get(level, 0) <= SUBTRIE:
            return level, 1
    return GROUPS, -(-most[GROUPS] // SUBTRIE)


class Matrix:
    """Words as padded rows of letters, from the front and from the back."""

    def __init__(self, words: list[str], pad: int):
        self.words = words
        codes, self.size = codes_of(words)
        wide = int(min(WIDE, self.size.max(initial=1)))
        first = np.cumsum(self.size) - self.size
        self.front = np.full((len(words), wide), pad, np.uint32)
        self.back = np.full((len(words), wide), pad, np.uint32)
        short = np.minimum(self.size, wide)
        row, col = np.repeat(np.arange(len(words)), short), A.spans(short)
        self.front[row, col] = codes[np.repeat(first, short) + col]
        self.back[row, col] = codes[np.repeat(first + self.size - 1, short) - col]
        self.head, self.tail = (_packed(x) for x in (self.front, self.back))
        self.unused = np.where(self.size >= 7, 0, np.where(self.size >= 5, 21, 63)).astype(np.uint64)


def _packed(letters: np.ndarray) -> np.ndarray:
    """The first three letters of each row in 63 bits, the first in the highest."""
    out = np.zeros(len(letters), np.uint64)
    for k in range(3):
        out = out << np.uint64(21) | (letters[:, k] & np.uint32((1 << 21) - 1) if k < letters.shape[1] else np.zeros(len(letters), np.uint32)).astype(np.uint64)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = min(a.shape[1], b.shape[1])
    differ = a[:, :wide] != b[:, :wide]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), wide)


def one_edit(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced letter?"""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p, short = 0, min(len(a), len(b))
    while p < short and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    return (a[p:] == b[p + 1 :]) if len(a) < len(b) else (a[p + 1 :] == b[p:])


def verified(asked: Matrix, held: Matrix, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (asked word i, held word j) are exactly one edit apart."""
    # p + s >= longest - 1: three letters (of five or six, two) at one end are equal
    unused = asked.unused[i]
    near = (asked.head[i] ^ held.head[j]) >> unused == 0
    near |= (asked.tail[i] ^ held.tail[j]) >> unused == 0
    near = np.flatnonzero(near)
    all_pairs, i, j = np.zeros(len(i), bool), i[near], j[near]
    la, lb = asked.size[i], held.size[j]
    longest = np.maximum(la, lb)
    out = np.zeros(len(i), bool)
    close = np.abs(la - lb) <= 1
    short = np.flatnonzero(close & (longest <= WIDE))
    p = _common(asked.front[i[short]], held.front[j[short]])
    s = _common(asked.back[i[short]], held.back[j[short]])
    same = (p == la[short]) & (p == lb[short])
    out[short] = ~same & (p + s >= longest[short] - 1)
    for k in np.flatnonzero(close & (longest > WIDE)).tolist():
        out[k] = one_edit(asked.words[i[k]], held.words[j[k]])
    all_pairs[near] = out
    return all_pairs


class Trie:
    """Words by their vectors, level by level; nodes of a level are numbered
    in order, and ``keys[level]`` holds (parent, count) of each."""

    def __init__(self, words: list[str], n: np.ndarray):
        v = vectors(words)
        order = np.lexsort(v.T[::-1])
        self.words, self.n, v = [words[k] for k in order.tolist()], n[order], v[order]
        self.base = int(v.max(initial=0)) + 2
        self.keys, new, node = [], np.zeros(len(v), bool), np.zeros(len(v), np.int64)
        new[:1] = True
        for level in range(GROUPS):
            parent = node
            new = new.copy()
            new[1:] |= v[1:, level] != v[:-1, level]
            node = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            self.keys.append(parent[at] * self.base + v[at, level])
        self.first = np.append(np.flatnonzero(new), len(v))
        self.rank = ranks(self.words)
        self.matrix = Matrix(self.words, 0xFFFFFFFF)

    def leaves(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of v, leaf) in reach of a surplus and a deficit of one, by a
        depth-first search that carries all rows down together."""
        stack = [(0, np.arange(len(v)), np.zeros(len(v), np.int64), 1, 1)]
        while stack:
            level, row, node, surplus, deficit = stack.pop()
            if level == GROUPS:
                yield row, node
                continue
            keys, count = self.keys[level], v[row, level].astype(np.int64)
            for step in (0, 1, -1):
                if step > surplus or -step > deficit:
                    continue
                want = count + step
                key = node * self.base + want
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[at] == key) & (want >= 0) & (want < self.base)
                if hit.any():
                    stack.append((level + 1, row[hit], at[hit], surplus - (step > 0), deficit - (step < 0)))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of words, held word) for all pairs that are near."""
        asked, v = Matrix(words, 0xFFFFFFFE), vectors(words)
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row, leaf in self.leaves(v):
            size = self.first[leaf + 1] - self.first[leaf]
            ends = np.cumsum(size)
            x = 0
            while x < len(row):  # some leaves at a time, of a large one some words
                y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PAIRS, side="right")))
                i, j = np.repeat(row[x:y], size[x:y]), np.repeat(self.first[leaf[x:y]], size[x:y]) + A.spans(size[x:y])
                for a in range(0, len(i), PAIRS):
                    ok = verified(asked, self.matrix, i[a : a + PAIRS], j[a : a + PAIRS])
                    rows.append(i[a : a + PAIRS][ok])
                    found.append(j[a : a + PAIRS][ok])
                x = y
        return np.concatenate(rows), np.concatenate(found)


def ranks(words: list[str]) -> np.ndarray:
    """Place of each word in code-point order."""
    out = np.empty(len(words), np.int64)
    out[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return out


def best_of(row: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of others, the best of them) from pairs: the largest n, ties to the first rank."""
    order = np.lexsort((rank[other], -n[other], row))
    row, other = row[order], other[order]
    at = np.flatnonzero(np.diff(row, prepend=-1))
    return row[at], np.diff(np.append(at, len(row))), other[at]


_ENTRY = "key long, part int, kind int, word string, n long"
_NEAR = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): for words (word, n; each once) that have a
    near word, their number and the one of largest n, ties to the smaller."""
    spark = words.sparkSession
    levels, parts = _levels(words)

    def entries(batches):
        for b in batches:
            text, n = b.column(0).to_pylist(), b.column(1)
            v = vectors(text)
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in text), np.int32, len(text))
            yield pa.RecordBatch.from_arrays([pa.array(paths(v[:, :levels])[-1].view(np.int64)), pa.array(part), pa.array(np.zeros(len(text), np.int32)), b.column(0), n], names=["key", "part", "kind", "word", "n"])
            for rows, key, own in reach(v, levels):
                took, count, one = b.column(0).take(pa.array(rows)), n.take(pa.array(rows)), np.ones(len(rows), np.int32)
                for k in range(parts):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(one * np.int32(k)), pa.array(one if own else 2 * one), took, count], names=["key", "part", "kind", "word", "n"])

    def search(batches):
        trie, now, held = None, None, ([], [])
        for (key, part, kind), piece in C.pieces(batches, ("key", "part", "kind")):
            if (key, part) != now:
                now, held, trie = (key, part), ([], []), None
            text = piece.column(3).to_pylist()
            if kind == 0:
                held[0].extend(text)
                held[1].extend(piece.column(4).to_pylist())
                continue
            if trie is None:
                if not held[0]:
                    continue  # nobody lives there
                trie = Trie(held[0], np.array(held[1], np.int64))
            counts = piece.column(4).to_numpy()
            for a in range(0, len(text), CHUNK):
                asked, n = text[a : a + CHUNK], counts[a : a + CHUNK]
                row, held_word = trie.near(asked)
                yield answer(asked, trie.words, trie.n, best_of(row, held_word, trie.n, trie.rank))
                if kind == 2:  # from another path: nobody asks the other way round
                    yield answer(trie.words, asked, n, best_of(held_word, row, n, ranks(asked)))

    def answer(words, others, n, found):
        row, count, best = found
        return pa.RecordBatch.from_arrays([
            pa.array([words[k] for k in row.tolist()], pa.string()), pa.array(count), pa.array(n[best]),
            pa.array([others[k] for k in best.tolist()], pa.string())], names=["word", "n_near", "best_n", "best"])

    tasks = C.partitions(spark, 0)
    dealt = words.select("word", "n").repartition(tasks).mapInArrow(entries, _ENTRY)
    dealt = dealt.repartition(4 * tasks, "key", "part").sortWithinPartitions("key", "part", "kind")
    near = dealt.mapInArrow(search, _NEAR).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
    return near.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): follow forms to a word without one."""
    last = C.saved(forms.where("form is null").select("word", F.col("word").alias("root")), "roots")
    have = C.saved(forms.where("form is not null").select("word", "form"), "forms")
    out = last
    while not last.isEmpty():
        known = last.select(F.col("word").alias("form"), "root")
        last = C.saved(have.join(known, "form").select("word", "root"), "roots")
        out = out.union(last)
    return out


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n; each once): a
    word's form is its best near word if that occurs ``ratio`` times as often."""
    near = C.saved(near_words(words), "near")
    rows = words.join(near, "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    rows = C.saved(rows, "formed")
    return rows.join(roots(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def variants(docs: DataFrame, damage: int = DAMAGE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    words = C.saved(count_words(docs, damage, min_letters).where(F.col("n") >= min_count), "words")
    return group_variants(words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(C.load(spark, sf_dir, "documents"))
