"""BPE encoding and decoding with a public vocabulary.

Encoding follows the tokenizer file (tokenizers JSON: NFC, white space as
separator, per-character lower case, a split pattern, byte-level symbols with
an end-of-word mark, ranked merges; special tokens are taken from the raw
text).  A word's symbols form a doubly linked list; a priority queue holds the
ranks of neighbouring pairs, lowest rank and leftmost first, and entries whose
pair has meanwhile changed are skipped as stale.  Decoding concatenates the
vocabulary strings of the ids with the tokenizer's separator (no decoder in
the file: one space).

Plan.  A map over the texts, no shuffle.  The vocabulary (one file of fixed
size, read once by the driver at ``path``) travels with the task.  Words
between white space are encoded once and kept in a bounded table per worker;
on overflow the table starts anew, so memory is bounded for any corpus.

Defined cases.  Null texts are empty; empty texts have no ids and decode to
an empty string.  Every row gives a row, repeated rows alike; null ids stay
null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from inspectkit.llm import corpus as C

KEPT_WORDS = 1_000_000
OUT_BYTES = 2 << 20

#: Python's split() takes these for white space, the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """A tokenizer file's rules as tables."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        model = t["model"]
        if model["type"] != "BPE" or t.get("post_processor") or t.get("decoder"):
            raise ValueError("a BPE file without post-processor and decoder is expected")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in t["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        split = next(p for p in t["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        # the file's own rules for scripts that Unicode versions differ on
        whole = Tokenizer.from_str(spec)
        self.rules = whole.normalizer.normalize_str, Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        #: rank of a pair of ids, and the id that a rank's merge gives
        self.ranks, self.result = {}, []
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[x] << 20 | vocab[y]] = rank
            self.result.append(vocab[x + y])
        self.words: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        inner = self.inner
        ids = [inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n, rank_of = len(ids), self.ranks.get
        if n == 1:
            return ids
        place = n.bit_length()
        mask = (1 << place) - 1
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        #: rank of each symbol and its right neighbour; -1: no merge
        now = [rank_of(x << 20 | y, -1) for x, y in zip(ids, ids[1:])]
        queue = [r << place | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(queue)
        now.append(-1)
        result = self.result
        while queue:
            top = heapq.heappop(queue)
            i, rank = top & mask, top >> place
            if now[i] != rank:
                continue  # stale: one of the two has been merged since
            j = after[i]
            new = ids[i] = result[rank]
            ids[j] = now[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                r = now[i] = rank_of(new << 20 | ids[k], -1)
                if r >= 0:
                    heapq.heappush(queue, r << place | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = now[h] = rank_of(ids[h] << 20 | new, -1)
                if r >= 0:
                    heapq.heappush(queue, r << place | h)
        return [i for i in ids if i >= 0]

    def word(self, chunk: str) -> bytes:
        """Ids of the text between two stretches of white space, packed."""
        if chunk.isascii():
            pieces = self.pieces(chunk.lower())
        elif max(chunk) < "\u0250":
            pieces = self.pieces("".join(map(str.lower, unicodedata.normalize("NFC", chunk))))
        else:
            normalize, split = self.rules
            pieces = [p for p, _ in split(normalize(chunk))]
        out = array("I", [i for p in pieces for i in self.merged(p.encode())]).tobytes()
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        if len(chunk) <= 64:
            self.words[chunk] = out
        return out

    def plain(self, text: str) -> bytes:
        chunks = text.split() if not _NOT_SPACE.search(text) else [c for c in _SPACE.split(text) if c]
        known, word = self.words.get, self.word
        return b"".join([known(c) or word(c) for c in chunks])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not any(token in text for token in self.special):
            return self.plain(text)
        parts = self.specials.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[int, Codec] = {}


def codec(spec: str) -> Codec:
    key = hash(spec)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit
    integers, packed) and decoded (the text that the ids decode to)."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            doc, text = batch.column(0), batch.column(1)
            start, held, ids, out = 0, 0, [], []
            for k, t in enumerate(text):
                ids.append(c.encode(t.as_py() or ""))
                out.append(c.decode(ids[-1]))
                held += len(ids[-1]) + len(out[-1])
                if held >= OUT_BYTES or k == len(text) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [doc.slice(start, k + 1 - start), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(out, pa.string())],
                        names=["doc_id", "n_tokens", "ids", "decoded"])
                    start, held, ids, out = k + 1, 0, [], []

    return C.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(C.load(spark, sf_dir, "documents"), vocabulary_path()))
