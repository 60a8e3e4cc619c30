"""Best-fit packing of token sequences by a configuration linear program.

The lengths of all pieces form a histogram of at most ``size`` bars. A configuration is a
multiset of lengths that fit one sequence; the linear program asks for the fewest (fractional)
configurations that cover the histogram. Each step takes the dearest length that is not yet
covered, and a knapsack dynamic program fills the rest of its sequence at the highest price,
with no length more often than is left of it; the configuration is used until one of its lengths
is covered. So every length ends covered exactly once over, by at most one configuration a
length. Prices bound the optimum from below; while the gap is above ``GAP``, the lengths in
wasteful configurations become dearer (multiplicative weights) and the sweep is repeated. Each
solution is rounded down, what is left over is packed by best-fit on the histogram, and the
packing of fewest sequences counts; one that meets the bound ends the sweeps. Only the histogram and the configurations, whose number is bounded by the lengths, are on the driver; the
pieces find their places by rank within their length, in parallel.
"""

from __future__ import annotations

import logging
import zlib
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import materialize, text_slices

SIZE = 2048
#: sweeps of the linear program at most, and its step of the weights
ROUNDS = 250
STEP = 0.1
#: gap to the lower bound that ends it, and sweeps without a better solution that do
GAP = 0.002
STALLED = 4
#: pieces of one length are ranked within buckets of about so many pieces, then by the buckets' sums
BUCKET_PIECES = 100_000
#: bytes of text whose new words are encoded together; chunks of a worker's memory that make a generation, of which it keeps two, and their longest
LEARN_BYTES = 2 << 20
CACHE_CHUNKS = 250_000
LONGEST_CACHED = 64
_LOG = logging.getLogger(__name__)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_KNOWN: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: a byte's letter in the vocabulary
_LETTERS = [c for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]


def _plain(word: str) -> bool:
    """Whether the vocabulary's normalisation and splitting leave a lower-cased word as it is, alone and before punctuation.

    So it is for words of Latin letters below U+0250 that are composed and without marks: no
    letter of theirs decomposes, joins its neighbour or is split off.
    """
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and is_normalized("NFC", word) and word.lower().isalpha() and max(word.lower()) < "\u0250"))


def _stem(chunk: str) -> tuple[str, str]:
    """A plain word in lower case and the punctuation after it; all of any other chunk and nothing."""
    word = chunk.rstrip(_PUNCTUATION)
    return (word.lower(), chunk[len(word) :]) if word.isascii() and word.isalpha() or _plain(word) else (chunk, "")


def _encode_new(path: str, texts: set[str]) -> dict[str, bytes]:
    """Ids of distinct stems and other chunks, by the tokenizers library.

    Plain lower-case words go straight to its merges, as the bytes' letters; others go through
    its normalisation and splitting too.
    """
    tk, rest = _tokenizer(path), []
    merge = tk.model.tokenize
    words, flat, ends = [], [], [0]
    for t in texts:
        if t.isascii() and t.isalpha() and t.islower():
            found = merge(t)
        elif t.islower() and _plain(t):
            found = merge("".join([_LETTERS[b] for b in t.encode()]))
        else:
            rest.append(t)
            continue
        words.append(t)
        flat += [x.id for x in found]
        ends.append(4 * len(flat))
    flat = array("I", flat).tobytes()
    out = {t: flat[lo:hi] for t, lo, hi in zip(words, ends, ends[1:], strict=False)}
    for lo in range(0, len(rest), 1000):
        part = rest[lo : lo + 1000]
        out |= {t: array("I", e.ids).tobytes() for t, e in zip(part, tk.encode_batch_fast(part, add_special_tokens=False), strict=True)}
    return out


def _word_ids(path: str, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text as little-endian 32-bit integers, by the tokenizers library.

    The vocabulary drops white space and no token, normalisation or special token reaches
    across a space or line feed, so chunks between these are encoded on their own and remembered.
    A full memory becomes the older one, from which chunks that are met again are taken over, so
    frequent chunks are encoded once and rare ones are forgotten.
    """
    known, older = _KNOWN.get(path, ({}, {}))
    if len(known) > CACHE_CHUNKS:
        known, older = {}, known
    _KNOWN[path] = known, older
    split = [t.replace("\n", " ").split(" ") for t in texts]
    unmet = set().union(*split).difference(known)
    again = {p: older[p] for p in unmet if p in older}
    known |= again
    unmet.difference_update(again)
    # most new chunks are a word alone
    words = {p: p.lower() for p in unmet if p.isascii() and p.isalpha()}
    pairs = {p: _stem(p) for p in unmet.difference(words)}
    stems = set(words.values()).union(*pairs.values()).difference(known)
    again = {x: older[x] for x in stems if x in older}
    known |= again
    ids = _encode_new(path, stems.difference(again))
    long = {x: ids.pop(x) for x in [x for x in ids if len(x) > LONGEST_CACHED]}
    known |= ids
    every = ChainMap(known, long) if long else known
    made = {p: every[x] for p, x in words.items() if p != x}
    made |= {p: every[word] + every[end] for p, (word, end) in pairs.items() if p not in every}
    long |= {p: made.pop(p) for p in [p for p in made if len(p) > LONGEST_CACHED]}
    known |= made
    every = ChainMap(known, long) if long else known
    return (b"".join(map(every.__getitem__, s)) for s in split)


def _pieces(path: str, size: int):
    def run(batches):
        for batch in batches:
            for lo, hi, _, _ in text_slices(batch.column(1), LEARN_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, piece, start, length, crc = [], [], [], [], []
                for doc, b in zip(part.column(0).to_pylist(), _word_ids(path, part.column(1).fill_null("").to_pylist()), strict=True):
                    b += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(b), 4 * size)):
                        cut = b[at : at + 4 * size]
                        ids.append(doc)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and a closing id 0, cut only beyond ``size``.

    A null or empty text is the closing id alone. Long texts are encoded whole. Null ids stay
    null; repeated rows come back as often. Extra columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return df.mapInArrow(_pieces(path, size), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_value(price: np.ndarray, lengths: np.ndarray, size: int) -> float:
    """Unbounded knapsack: the highest total price of a multiset of lengths within ``size``."""
    best = np.zeros(size + 1)
    for room in range(1, size + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        best[room] = max(best[room - 1], float((best[room - lengths[:n]] + price[:n]).max())) if n else best[room - 1]
    return float(best[size])


def _fill(price: np.ndarray, lengths: np.ndarray, most: np.ndarray, room: int) -> dict[int, int]:
    """Knapsack of at most ``most`` of each length within ``room``, dearest per token first.

    It ends early where no further length can add more than ``GAP`` of the price.
    """
    density = price / lengths
    best, takes = np.zeros(room + 1), []
    for k in np.argsort(-density, kind="stable").tolist():
        if best[room] >= (1 - GAP / 2) * density.max() * room:
            break
        n, m = min(int(most[k]), room // int(lengths[k])), 1
        while n > 0:
            m = min(m, n)
            n -= m
            span = m * int(lengths[k])
            value = best[:-span] + m * price[k]
            up = value > best[span:]
            best[span:] = np.where(up, value, best[span:])
            takes.append((k, m, span, up))
            m *= 2
    config: dict[int, int] = {}
    for k, m, span, up in reversed(takes):
        if room >= span and up[room - span]:
            config[k] = config.get(k, 0) + m
            room -= span
    return config


def _sweep(price: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int) -> dict[tuple[tuple[int, int], ...], float]:
    """{configuration: copies} that cover every count exactly; copies may be fractions."""
    left, found = counts.astype(float), {}
    for first in np.lexsort((-lengths, -price)).tolist():
        while left[first] > 0:
            most = np.floor(left + 1e-9)
            most[first] -= 1
            live = np.flatnonzero((most > 0) & (lengths <= size - lengths[first]))
            config = {first: 1}
            if len(live):
                for k, m in _fill(price[live], lengths[live], most[live], size - int(lengths[first])).items():
                    config[int(live[k])] = config.get(int(live[k]), 0) + m
            copies = min(left[k] / m for k, m in config.items())
            for k, m in config.items():
                left[k] = left[k] - m * copies if left[k] - m * copies > 1e-9 else 0.0
            key = tuple(sorted(config.items()))
            found[key] = found.get(key, 0.0) + copies
    return found


def _sweeps(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int, step: float) -> Iterator[tuple[dict[tuple[tuple[int, int], ...], float], float, float]]:
    """(solution, its copies' sum, best lower bound so far) of each sweep, until the gap is closed or no sweep betters the best."""
    weight, stalled = 1 + GAP / 2 * lengths / size, 0
    total, bound = np.inf, max(float(lengths @ counts) / size, float(counts[2 * lengths > size].sum()))
    for turn in range(max(1, rounds)):
        price = lengths * weight
        if turn:
            bound = max(bound, float(price @ counts) / _best_value(price, lengths, size))
        found = _sweep(price, lengths, counts, size)
        now = sum(found.values())
        stalled = 0 if now < total - 1e-9 else stalled + 1
        total = min(total, now)
        yield found, now, bound
        if total <= (1 + GAP) * bound or stalled == STALLED:
            break
        waste = np.zeros(len(lengths))
        for config, copies in found.items():
            empty = 1 - sum(int(lengths[k]) * m for k, m in config) / size
            for k, m in config:
                waste[k] += m * copies * empty / counts[k]
        weight = weight * (1 + step) ** (waste / max(waste.max(), 1e-12))
        weight /= weight.min()


def linear_program(lengths: np.ndarray, counts: np.ndarray, size: int = SIZE, rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """({((index of length, multiplicity), ...): copies}, lower bound of the copies' sum).

    Every length is covered exactly. The bound is the best of: all tokens by ``size``, the
    pieces longer than half of it, and the worth of the histogram at each sweep's prices.
    """
    best, total, bound = {}, np.inf, 0.0
    for found, now, bound in _sweeps(lengths, counts, size, rounds, step):
        if now < total - 1e-9:
            best, total = found, now
    _LOG.info("configuration LP: %.2f sequences, lower bound %.2f, gap %.4f", total, bound, total / bound - 1)
    return best, bound


def rounded(found: dict[tuple[tuple[int, int], ...], float]) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The whole copies of a fractional solution."""
    whole = ((config, int(copies + 1e-9)) for config, copies in sorted(found.items(), key=lambda x: -x[1]))
    return [(config, n) for config, n in whole if n]


def _completed(found: dict[tuple[tuple[int, int], ...], float], lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The whole copies of a fractional solution, and what they leave by best fit."""
    left, out = counts.copy(), []

    def use(config: dict[int, int], copies: int) -> None:
        out.append(([(int(lengths[k]), n) for k, n in sorted(config.items(), reverse=True)], copies))
        for k, n in config.items():
            left[k] -= n * copies

    for config, copies in rounded(found):
        use(dict(config), copies)
    while left.any():
        config, room = {}, size
        k = int(np.flatnonzero(left)[-1])
        while k >= 0:
            config[k] = config.get(k, 0) + 1
            room -= int(lengths[k])
            k = int(np.searchsorted(lengths, room, "right")) - 1
            while k >= 0 and left[k] <= config.get(k, 0):
                k -= 1
        use(config, min(int(left[k] // n) for k, n in config.items()))
    return out


def configurations(lengths: np.ndarray, counts: np.ndarray, size: int = SIZE, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths with multiplicity, copies)]: sequences that use each length exactly as often as it occurs.

    ``lengths`` ascend; all are at least 1 and at most ``size``. Every sweep's solution is rounded
    and completed, and the one of fewest sequences is taken. Sweeps end early once that reaches
    the lower bound, which no packing can beat.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if len(lengths) < 2:
        return _completed({}, lengths, counts, size)
    best, fewest, turns = [], np.inf, 0
    for found, total, bound in _sweeps(lengths, counts, size, rounds, step):
        made, turns = _completed(found, lengths, counts, size), turns + 1
        n = sum(copies for _, copies in made)
        if n < fewest:
            best, fewest = made, n
        _LOG.info("sweep %d: %.2f sequences, rounded %d, lower bound %.2f", turns, total, n, bound)
        if fewest <= np.ceil(bound - 1e-6):
            break
    return best


def _placed(plan):
    def run(batches):
        keys, a, base, offset = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            within = (length << 48) + rank - keys[i]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(base[i] + within // a[i]), pa.array(offset[i] + within % a[i] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, size: int = SIZE, rounds: int = ROUNDS, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless sequences of at most ``size`` tokens.

    Takes the columns of ``token_pieces``; others are ignored. Repeated rows are packed as
    often as they occur; which of the pieces of one length goes where is arbitrary. No piece, no
    sequence. A piece of ``size`` tokens is a sequence by itself and needs no rank; its
    sequence_id is negative. Pieces of one length are ranked in as many buckets as their number
    asks for, dealt by row, so no length and no document is one task's.
    """
    spark = pieces.sparkSession
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = materialize(pieces.select(*columns, F.monotonically_increasing_id().alias("row")), "pieces")
    full = pieces.filter(F.col("length") == size).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    bars = pieces.filter(F.col("length") < size).groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()  # fewer than ``size`` rows
    if not bars:
        return full
    lengths, counts = np.array([b["length"] for b in bars]), np.array([b["n"] for b in bars])
    keys, each, bases, offsets = [], [], [], []
    rank, base = dict.fromkeys(lengths.tolist(), 0), 0
    for config, copies in configurations(lengths, counts, size, rounds):
        at = 0
        for length, n in config:
            keys.append((length << 48) + rank[length])
            each.append(n)
            bases.append(base)
            offsets.append(at)
            rank[length] += n * copies
            at += n * length
        base += copies
    order = np.argsort(np.array(keys))
    plan = spark.sparkContext.broadcast(tuple(np.array(x)[order] for x in (keys, each, bases, offsets)))
    buckets = -(-int(counts.max()) // bucket_pieces)
    short = pieces.filter(F.col("length") < size).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    ahead = short.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "ahead")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = short.withColumn("own", own).join(ahead, ["length", "bucket"]).select(*columns, (F.col("own") + F.col("ahead")).alias("rank"))
    placed = ranked.mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.unionByName(full)
