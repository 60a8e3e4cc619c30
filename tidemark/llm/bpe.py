"""Byte-level BPE by prefix-sharing trie traversal.

The encoding of a prefix is settled by its last token: with that token removed, what is left
is again the encoding of a shorter prefix. The distinct new words of some megabytes of text
are walked as a trie, depth first: in sorted order, neighbours share the states of their common
prefix, so shared prefixes are encoded once. A token may follow another if byte pair merging
would not join anything across their border, which a look at the merge ranks of both tokens'
edges tells.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: words, chunks and pairs of tokens that a worker remembers
CACHE_WORDS = 200_000
CACHE_CHUNKS = 300_000
CACHE_PAIRS = 500_000
#: bytes of text whose new words are walked as one trie
LEARN_BYTES = 4 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = 1 << 60
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in such vocabularies, by the public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: what is remembered of a word or chunk: its ids as 32-bit integers, in decimals, and the bytes they decode to
Known = tuple[bytes, str, bytes]


class Encoder:
    """A tokenizer file's byte-level BPE: ``encode`` and ``decode`` as the tokenizers library does them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in self.ids.items():
            self.pieces[i] = t
        for t, i in self.special.items():
            self.pieces[i] = t.encode()
        self.decimal = [str(i) for i in range(len(self.pieces))]
        # tokens read backwards, as a trie: state << 8 | byte -> state; and the token that a state spells, or -1
        self.back: dict[int, int] = {}
        self.spells = [-1]
        for t, i in self.ids.items():
            state = 0
            for b in reversed(t):
                key = state << 8 | b
                if (state := self.back.get(key, 0)) == 0:
                    state = self.back[key] = len(self.spells)
                    self.spells.append(-1)
            self.spells[state] = i
        self.judged: dict[int, bool] = {}
        self.rank, self.parts = {}, {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(a), raw(b)
            p = (self.ids[a], self.ids[b])
            self.rank[p] = n
            self.parts[self.ids[a + b]] = (*p, n)
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str | int, Known] = {}
        self.chunks: dict[str | tuple, Known] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that takes it in) down the left (0) or right (1) edge of a token."""
        if (found := self.edges.get((token, side))) is None:
            found, part, limit = [], token, NEVER
            while True:
                found.append((part, limit))
                if (made := self.parts.get(part)) is None:
                    break
                part, limit = made[side], made[2]
            self.edges[token, side] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` ends in just these two: at no time does a pair across the border merge."""
        rank = self.rank
        for x, until in self.edge(a, 1):
            for y, also in self.edge(b, 0):
                if (r := rank.get((x, y))) is not None and r < until and r <= also:
                    return False
        return True

    def _known(self, ids: list[int]) -> Known:
        return array("I", ids).tobytes(), ",".join([self.decimal[i] for i in ids]), b"".join([self.pieces[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Encode distinct words in the order of their bytes; a path of the trie is kept as one state a byte."""
        step, spells, known, judged = self.back.get, self.spells, self.known, self.judged
        if len(judged) > CACHE_PAIRS:
            judged.clear()
        last: list[int] = [-1]
        back: list[int] = [0]
        before = b""
        for w, word in sorted([(p.encode("utf-8", "surrogatepass"), p) for p in words]):
            same, most = 0, min(len(w), len(before))
            while same < most and w[same] == before[same]:
                same += 1
            del last[same + 1 :], back[same + 1 :]
            for d in range(same + 1, len(w) + 1):
                # tokens that end here, short to long
                fits, start, state = [], d, 0
                while start:
                    start -= 1
                    if (state := step(state << 8 | w[start])) is None:
                        break
                    if (t := spells[state]) >= 0:
                        fits.append((start, t))
                for start, t in reversed(fits):
                    if start:
                        pair = last[start] << 20 | t
                        if (ok := judged.get(pair)) is None:
                            ok = judged[pair] = self.may_follow(last[start], t)
                        if not ok:
                            continue
                    last.append(t)
                    back.append(start)
                    break
            out, d = [], len(w)
            while d:
                out.append(last[d])
                d = back[d]
            out.reverse()
            known[word] = self._known(out)
            before = w

    def _pieces(self, text: str) -> list:
        """A text's words, and the ids of its special tokens."""
        if not any(s in text for s in self.special):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [*self.words.findall(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.words.findall(text[at:])

    def _pieces_of_chunk(self, chunk: str) -> list[str]:
        """The words of a chunk, which begins with its space if it has one."""
        stem = chunk.rstrip(PUNCTUATION)
        if stem[1:].isalpha() and max(stem) < "\u0250" and (stem[0] == " " or stem[0].isalpha()):
            return [stem] if len(stem) == len(chunk) else [stem, chunk[len(stem) :]]
        return self.words.findall(chunk)

    def chunked(self, texts: list[str]) -> tuple[list[Known], np.ndarray, np.ndarray]:
        """(what is known of the distinct chunks, the chunks of all texts by their numbers, the texts' bounds in these).

        A single space after a non-empty piece always starts a new word, so such texts are cut
        before their spaces; others are one chunk, which is not remembered.
        """
        chunks, known = self.chunks, self.known
        if len(chunks) > CACHE_CHUNKS:
            chunks.clear()
        if len(known) > CACHE_WORDS:
            known.clear()
        whole = [n for n, t in enumerate(texts) if not t or t[0] == " " or t[-1] == " " or "  " in t or any(s in t for s in self.special)]
        plain = list(texts)
        for n in whole:
            plain[n] = ""
        cut = pc.split_pattern(pa.array(plain, pa.string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        # twice the number of the chunk, and 1 more for a text's first, which has no space before it
        codes = coded.indices.to_numpy().astype(np.int64) * 2
        codes[bounds[:-1]] += 1
        codes[bounds[whole]] = 2 * len(coded.dictionary) + np.arange(len(whole))
        used = np.zeros(2 * len(coded.dictionary) + len(whole), bool)
        used[codes] = True
        codes = (np.cumsum(used) - 1)[codes]
        names, n_plain = coded.dictionary.to_pylist(), 2 * len(coded.dictionary)
        keys = [(texts[whole[k - n_plain]],) if k >= n_plain else names[k >> 1] if k & 1 else " " + names[k >> 1] for k in np.flatnonzero(used).tolist()]
        new = {k: self._pieces(k[0]) if k.__class__ is tuple else self._pieces_of_chunk(k) for k in keys if k not in chunks}
        self.learn({p for s in new.values() for p in s if p.__class__ is str and p not in known})
        for i in self.special.values():
            known[i] = self._known([i])
        passing = {}
        for k, pieces in new.items():
            if len(pieces) == 1:
                found = known[pieces[0]]
            else:
                ids, decimals, raw = zip(*[known[x] for x in pieces], strict=True) if pieces else ((), (), ())
                found = b"".join(ids), ",".join(decimals), b"".join(raw)
            (passing if k.__class__ is tuple else chunks)[k] = found
        return [passing[k] if k.__class__ is tuple else chunks[k] for k in keys], codes, bounds

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        found, codes, bounds = self.chunked(texts)
        ids = [f[0] for f in found]
        every = np.frombuffer(b"".join([ids[c] for c in codes.tolist()]), np.uint32)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[codes] // 4)])[bounds]
        return [every[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, row after the last, texts) of runs of about ``LEARN_BYTES``; null counts as empty."""
    for lo, hi, _, _ in text_slices(texts, LEARN_BYTES):
        yield lo, hi, texts.slice(lo, hi - lo).fill_null("").to_pylist()


def _encoded(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo, hi, texts in _groups(batch.column(1)):
                ids = enc.encode_batch(texts)
                for k in range(0, hi - lo, 64):
                    part = ids[k : k + 64]
                    ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
                    flat = pa.array(np.concatenate(part).view(np.int32))
                    yield pa.record_batch([batch.column(0).slice(lo + k, len(part)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "ids"])

    return run


def _decoded(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; a null text counts as empty, an empty one has no ids.

    Long texts are encoded whole; repeated rows and ids come back as often; null ids stay null.
    Extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return df.mapInArrow(_encoded(path), "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids); null ids give an empty text, ids outside the vocabulary raise."""
    return encoded.select("id", "ids").mapInArrow(_decoded(path), "id long, text string")


def _digests(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo, hi, texts in _groups(batch.column(1)):
                found, codes, bounds = enc.chunked(texts)
                lengths = np.fromiter((len(f[0]) // 4 for f in found), np.int64, len(found))
                n = np.diff(np.concatenate([[0], np.cumsum(lengths[codes])])[bounds])
                joined = lambda k, kind, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pa.array([f[k] for f in found], kind).take(pa.array(codes))), by)
                decimals, raw = joined(1, pa.string(), ","), joined(2, pa.binary(), b"")
                ids_sha = [hashlib.sha256(d.as_buffer()).hexdigest() for d in decimals]
                text_sha = [hashlib.sha256(str(r.as_buffer(), "utf-8", "replace").encode()).hexdigest() for r in raw]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass, so that long id lists never leave their task.

    Ids and decoded bytes are joined from those of the text's chunks. Nulls, long texts, repeats,
    extra columns and empty tables are handled as in ``encode``.
    """
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return df.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
