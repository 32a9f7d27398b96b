"""Byte-level BPE over whole texts, with a transducer lexicon for frequent words.

A first pass counts words over all documents (cut at single spaces). The most frequent ones are merged once and compiled, with their ids as outputs,
into a minimal acyclic transducer (``lexicon``) that Spark ships as a file and workers map into memory. A second pass cuts texts
into words, walks each batch's distinct words through the transducer side by side and merges those it doesn't hold by the exact rules,
also side by side. So the lexicon decides only the speed; the ids are always those of the vocabulary's merges. Each distinct piece is
decoded once from its ids.

Cutting: a single space that no white space precedes always begins a new word, so texts are split at single spaces at C speed and the
pattern sees each distinct piece once. Texts in which a space belongs to a longer run that the pattern may cut elsewhere (one with two
spaces, or a space between other white space or behind it at the end) are cut by the pattern as a whole.

Defined cases: a null text is empty: no ids, decoded to an empty text. Strings of added tokens inside a text become their ids, as
the tokenizers library does by default. Ids are decoded to bytes and these as UTF-8; invalid sequences become U+FFFD. A null id
list decodes to an empty text. An unknown id raises an error. The result has the input's row once, whatever repeats.
"""

from __future__ import annotations

import functools
import heapq
import json
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import scratch_root, settle
from .common import bound_batches, packed
from .lexicon import Lexicon, build

# The pattern of the vocabulary's pre-tokenizer, with white space spelled out as Unicode has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = 1 << 60      # rank of pairs that are never merged
LONG_WORD = 48      # bytes; longer words are merged with a queue
SIDE_BY_SIDE = 20_000   # words that are looked up or merged at a time
CUT_CHARS = 2 << 20     # code points of texts that are cut before their new pieces are encoded; one text may be longer
ENTRY = 300         # bytes that a known piece takes beside its own characters and ids, about
FLUSH = 400_000     # distinct pieces that a task counts before it hands them on


@functools.cache
def _cutter():
    return regex.compile(PATTERN), regex.compile(rf" (?:[{SPACE}]* |(?<=[{SPACE}] )(?:[{SPACE}]|\Z))")


def byte_names() -> dict[str, int]:
    """Character that stands for each byte in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _text(token, ids: list[int]) -> str:
    """The text of ids; ``token`` gives the bytes of one."""
    return b"".join(map(token, ids)).decode("utf-8", "replace")


class _Known:
    """Pieces and words that a worker has encoded: their ids as packed 32-bit numbers and the bytes these stand for, up to ``limit`` bytes."""

    def __init__(self, limit: int):
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        self.limit, self.held = limit, 0

    def add(self, piece: str, ids: bytes, raw: bytes) -> None:
        self.ids[piece], self.raw[piece] = ids, raw
        self.held += ENTRY + 2 * len(raw) + len(ids)

    def trim(self) -> None:
        if self.held > self.limit:
            self.ids, self.raw, self.held = {}, {}, 0


_MEMO: dict[str, _Known] = {}


def _known(lexicon: str, limit: int) -> _Known:
    """What this worker has looked up in a lexicon; a worker serves many tasks. Other lexicons' go."""
    if lexicon not in _MEMO:
        _MEMO.clear()
    return _MEMO.setdefault(lexicon, _Known(limit))


class Vocabulary:
    """Merges and tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], byte_names()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE file")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with conditions are not supported")
        ids = model["vocab"]
        self.tokens = {i: bytes(names[c] for c in t) for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.bytes = [ids[c] for c, _ in sorted(names.items(), key=lambda x: x[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = list(pairs)
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]

    def merge(self, word: bytes) -> list[int]:
        """The word's ids: the pair of the lowest rank is merged first, until none is left."""
        ids = [self.bytes[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get, made = self.ranks.get, self.made
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)       # of equal ranks the first
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
        return ids

    @functools.cached_property
    def _tables(self) -> tuple[np.ndarray, ...]:
        """For :meth:`merge_all`: id of each byte, rank of each pair of bytes, sorted pairs and their ranks, merged id by rank."""
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        ranks = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        order = np.argsort(keys)
        single = np.array(self.bytes, np.int64)
        first = np.full((256, 256), NONE, np.int64)
        at = {i: b for b, i in enumerate(self.bytes)}
        for (a, b), rank in self.ranks.items():
            if a in at and b in at:
                first[at[a], at[b]] = rank
        return single, first, keys[order], ranks[order], np.array(self.made, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, _, keys, ranks, _ = self._tables
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (a >= 0) & (b >= 0), ranks[at], NONE)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """:meth:`merge` of many words side by side; packed 32-bit ids."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[i] = array("i", self.merge(word)).tobytes()
            else:
                short.append(i)
        short.sort(key=lambda i: len(words[i]))     # alike lengths: little padding
        for lo in range(0, len(short), SIDE_BY_SIDE // 4):
            some = short[lo:lo + SIDE_BY_SIDE // 4]
            for i, ids in zip(some, self._merge_side_by_side([words[i] for i in some])):
                out[i] = ids
        return out

    def _merge_side_by_side(self, words: list[bytes]) -> list[bytes]:
        if not self.ranks:
            return [array("i", self.merge(w)).tobytes() for w in words]
        single, first, _, _, made = self._tables
        n, width = len(words), max(map(len, words))
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        lengths = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        # One place more than letters: what lies beyond a word's ends, never part of a pair.
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][inside] = single[letters[inside]]
        ranks = np.full((n, width + 1), NONE, np.int64)
        ranks[:, :width - 1] = np.where(inside[:, 1:], first[letters[:, :-1], letters[:, 1:]], NONE)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[:, width] = width
        ahead = np.tile(np.arange(-1, width), (n, 1))
        ahead[:, 0] = width
        after = np.where(after < lengths[:, None], after, width)
        rows = np.arange(n)
        while len(rows):
            i = ranks[rows].argmin(1)       # of equal ranks the first
            best = ranks[rows, i]
            going = best != NONE
            rows, i, best = rows[going], i[going], best[going]
            j = after[rows, i]
            k, h = after[rows, j], ahead[rows, i]
            ids[rows, i], ids[rows, j], ranks[rows, j] = made[best], -1, NONE
            after[rows, i], ahead[rows, k] = k, i
            ranks[rows, i] = self._rank(ids[rows, i], ids[rows, k])
            ranks[rows, h] = self._rank(ids[rows, h], ids[rows, i])
        left = ids >= 0
        ends = 4 * np.cumsum(left.sum(1))
        flat = ids[left].astype(np.int32).tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        get, queue = self.ranks.get, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := get((ids[i], ids[j]))) is not None:
                heapq.heappush(queue, (rank, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                ahead[after[i]] = i
            offer(i)
            if ahead[i] >= 0:
                offer(ahead[i])
        return [x for x in ids if x >= 0]


def pieces(text: str) -> list[str]:
    """Cut at single spaces only, or by the pattern where the text has runs with several spaces; joined, they are the text."""
    pattern, runs = _cutter()
    if "\0" in text or runs.search(text):
        return pattern.findall(text)
    parts = text.replace(" ", "\0 ").split("\0")
    return parts if parts[0] else parts[1:]


def piece_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): how often each piece, nearly always a word with its space, occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    seen.update(pieces(value.as_py()))
                    if len(seen) > FLUSH:
                        yield pa.record_batch({"piece": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
                        seen = Counter()
        yield pa.record_batch({"piece": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    return docs.select(text).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def ship_lexicon(spark: SparkSession, data: bytes) -> str:
    """Put the lexicon where every worker finds it, by way of the shared folder; returns its name for ``SparkFiles.get``."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path)
    try:
        out.write(data)
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def make_lexicon(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", size: int = 100_000, longest: int = 64) -> bytes:
    """Transducer of the words in the most frequent pieces, at most ``size`` of at most ``longest`` bytes: a bound on what the driver holds.

    The number that a piece must occur is read off the counts' histogram, so that no task or driver sorts pieces.
    """
    counts = settle(piece_counts(docs, text).where((F.octet_length("piece") <= longest) & (F.col("n") > 1)), "pieces")
    upto = W.orderBy(F.desc("n"))      # one row for each number that occurs
    fits = counts.groupBy("n").agg(F.count("*").alias("m")).withColumn("all", F.sum("m").over(upto)).where(F.col("all") <= size)
    least = fits.agg(F.min("n")).first()[0]
    top = counts.where(F.lit(False) if least is None else F.col("n") >= least).select("piece").toPandas()
    pattern, _ = _cutter()
    words = sorted({w.encode() for piece in top["piece"] for w in pattern.findall(piece)})
    return build((w, tuple(memoryview(ids).cast("i"))) for w, ids in zip(words, vocabulary.merge_all(words)))


def words_of(piece: str) -> list[str]:
    """A piece's words by the pattern, nearly always one."""
    if piece.isascii() and (piece.isalpha() or piece[0] == " " and piece[1:].isalpha()):
        return [piece]
    return _cutter()[0].findall(piece)


def encode_pieces(new: set[str], known: _Known, vocab: Vocabulary, lexicon: Lexicon) -> None:
    """Make the pieces ``new`` known: their words through the lexicon, those it doesn't hold by the merges."""
    made = {piece: words_of(piece) for piece in new}
    words = list({w for ws in made.values() for w in ws}.difference(known.ids))
    token = vocab.tokens.__getitem__
    for lo in range(0, len(words), SIDE_BY_SIDE):
        some = words[lo:lo + SIDE_BY_SIDE]
        raw = [w.encode() for w in some]
        found = lexicon.get_all(raw)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, vocab.merge_all([raw[i] for i in unseen])):
            found[i] = ids
        for word, ids in zip(some, found):
            known.add(word, ids, b"".join(map(token, memoryview(ids).cast("i"))))
    for piece, ws in made.items():
        if piece not in known.ids:
            known.add(piece, b"".join([known.ids[w] for w in ws]), b"".join([known.raw[w] for w in ws]))


def encode(
    docs: DataFrame, vocab_path: str, text: str = "text", keep: list[str] | None = None, lexicon_words: int = 100_000,
    memo_bytes: int = 192 << 20, decoded: str | None = None,
) -> DataFrame:
    """Every row of ``docs`` (of its columns ``keep``, or all) as struct ``row`` with its text's ``ids``.

    ``memo_bytes`` is about what a worker keeps at hand of pieces it has encoded. With ``decoded`` the ids' text comes along in a column of
    that name, decoded in the same task.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = Vocabulary(vocab_path)
    name = ship_lexicon(spark, make_lexicon(docs, vocabulary, text, lexicon_words))
    sent = spark.sparkContext.broadcast(vocabulary)     # bounded by the vocabulary file

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lexicon = sent.value, Lexicon(SparkFiles.get(name))
        added = regex.compile("|".join(map(regex.escape, sorted(vocab.added, key=len, reverse=True)))) if vocab.added else None
        known = _known(name, memo_bytes)

        def cut(value: str) -> list[str | int]:
            """Pieces, and the ids of added tokens between them."""
            if not (added and added.search(value)):
                return pieces(value)
            at, parts = 0, []
            for m in added.finditer(value):
                parts += [*pieces(value[at:m.start()]), vocab.added[m[0]]]
                at = m.end()
            return parts + pieces(value[at:])

        def several(texts: list[str]) -> Iterator[tuple[bytes, str | None]]:
            parts = [cut(value) for value in texts]
            known.trim()
            new = set().union(*parts).difference(known.ids)
            for token in [x for x in new if isinstance(x, int)]:
                known.add(token, array("i", [token]).tobytes(), vocab.tokens[token])
            encode_pieces({x for x in new if isinstance(x, str)}, known, vocab, lexicon)
            for some in parts:
                yield (b"".join(map(known.ids.__getitem__, some)),
                       b"".join(map(known.raw.__getitem__, some)).decode("utf-8", "replace") if decoded else None)

        for batch in batches:
            flat, ends, texts = [], [0], []
            pending, chars = [], 0
            values = batch.column("value")
            for at, value in enumerate(values, 1):
                pending.append(value.as_py() or "")
                chars += len(pending[-1])
                if chars >= CUT_CHARS or at == len(values):
                    for ids, back in several(pending):
                        flat.append(ids)
                        ends.append(ends[-1] + len(ids) // 4)
                        texts.append(back)
                    pending, chars = [], 0
            numbers = pa.array(np.frombuffer(b"".join(flat), np.int32))
            columns = {"row": batch.column("row"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers)}
            if decoded:
                columns[decoded] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    given = packed(docs, keep, value=F.col(text))
    return given.mapInArrow(task, f"row {given.schema['row'].dataType.simpleString()}, ids array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in column ``out``."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(Vocabulary(vocab_path).tokens)

    @F.pandas_udf("string")
    def text_of(lists):
        token = sent.value.__getitem__
        return lists.map(lambda x: "" if x is None else _text(token, x.tolist()))

    return encoded.withColumn(out, text_of(F.col(ids)))
