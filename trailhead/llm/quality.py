"""Quality rules: a linear-chain conditional random field labels each line of a document content or boilerplate.

A line's features are a few yes/no facts (its length, symbols, repeats, case, punctuation), packed into one small number. The field
has a weight for each feature and label and one for each pair of neighbouring labels. It is fitted by maximum likelihood
on a bounded sample of labelled documents (lines take their document's label), then sent to the tasks, where the Viterbi
recursion finds each document's best label sequence. The share of words that lie in content lines decides.

Word rules come before: a document fails outright with under ``min_words`` words, or with over half of its words in 3-word windows
that occur twice or more in it.

Defined cases: a null or empty text has no words and fails. Lines without a word get label ``-`` and take no part. Where the labels hold only
one class (or are empty) the field is not fitted and every line counts as content. Labelled documents whose id or label is null
are not used. Rows are judged one by one, so repeats all stay or all go.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, packed

SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "always", "one or two words", "three to nine words", "ten words or more", "a symbol", "a symbol in three words",
    "under half of its words differ", "all letters upper case", "ends a sentence", "an exclamation mark in three words",
    "a copy of an earlier line", "begins upper case", "long words", "a fifth digits",
)
CONTENT, BOILERPLATE = 0, 1


def line_code(line: bytes, words: list[bytes], repeated: bool) -> int:
    """The line's features as bits, in the order of ``FEATURES``."""
    n, size = len(words), len(line)
    text = line.decode("utf-8", "replace").strip()
    symbols = size - len(line.translate(None, SYMBOLS))
    digits = size - len(line.translate(None, b"0123456789"))
    facts = (
        True, n <= 2, 3 <= n < 10, n >= 10, symbols > 0, 3 * symbols >= n, n >= 5 and 2 * len(set(words)) < n, text.isupper(),
        text[-1:] in ".!?:;", 3 * line.count(b"!") >= n, repeated, text[:1].isupper(), size > 14 * n, 5 * digits > size,
    )
    return sum(1 << i for i, fact in enumerate(facts) if fact)


def read_lines(text: str) -> tuple[list[list[bytes]], list[int], int]:
    """Words by line (bytes split at ASCII white space), features by line (-1 without a word), number of repeated lines."""
    words, codes, seen, repeats = [], [], set(), 0
    for line in text.encode("utf-8", "replace").split(b"\n"):
        w = line.split()
        words.append(w)
        if not w:
            codes.append(-1)
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        codes.append(line_code(line, w, again))
    return words, codes, repeats


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) ** 3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(ids) + w[2:]
    order = np.argsort(key, kind="stable")
    equal = np.diff(key[order]) == 0
    if not equal.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


class LineField:
    """Weights of the field: ``emit`` (feature × label) and ``move`` (label × next label)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    @classmethod
    def neutral(cls) -> LineField:
        emit = np.zeros((len(FEATURES), 2))
        emit[0, CONTENT] = 1.0
        return cls(emit, np.zeros((2, 2)))

    @staticmethod
    def bits(codes: np.ndarray) -> np.ndarray:
        return (codes[..., None] >> np.arange(len(FEATURES)) & 1).astype(float)

    @classmethod
    def fit(cls, sequences: list[tuple[list[int], int]], steps: int = 300, rate: float = 0.1, prior: float = 1.0, piece: int = 64) -> LineField:
        """Maximum likelihood with a Gaussian prior by Adam; long sequences are learned in pieces."""
        cut = [(codes[i:i + piece], label) for codes, label in sequences for i in range(0, len(codes), piece)]
        if len({label for _, label in cut}) < 2:
            return cls.neutral()
        n, longest = len(cut), max(len(c) for c, _ in cut)
        x, mask, y = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest), bool), np.array([label for _, label in cut])
        for i, (codes, _) in enumerate(cut):
            x[i, :len(codes)] = cls.bits(np.array(codes))
            mask[i, :len(codes)] = True
        # Each class weighs the same, whatever its share of the sample.
        weight = 0.5 / np.bincount(y, minlength=2)[y]
        lines = mask.sum()
        theta = np.zeros(len(FEATURES) * 2 + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            emit, move = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
            e = x @ emit
            ahead, back = np.zeros_like(e), np.zeros_like(e)
            ahead[:, 0] = e[:, 0]
            for k in range(1, longest):
                step = np.logaddexp(ahead[:, k - 1, :1] + move[0], ahead[:, k - 1, 1:] + move[1]) + e[:, k]
                ahead[:, k] = np.where(mask[:, k, None], step, ahead[:, k - 1])
            for k in range(longest - 2, -1, -1):
                nxt = e[:, k + 1] + back[:, k + 1]
                step = np.stack([np.logaddexp(move[a, 0] + nxt[:, 0], move[a, 1] + nxt[:, 1]) for a in (0, 1)], 1)
                back[:, k] = np.where(mask[:, k + 1, None], step, 0)
            z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            node = np.where(mask[..., None], np.exp(ahead + back - z[:, None, None]), 0)
            truth = np.where(mask[..., None], np.eye(2)[y][:, None, :], 0)
            w = weight[:, None, None]
            grad_emit = np.einsum("nkf,nkl->fl", x, w * (truth - node))
            both = mask[:, 1:]
            grad_move = np.zeros((2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    edge = np.exp(ahead[:, :-1, a] + move[a, b] + e[:, 1:, b] + back[:, 1:, b] - z[:, None])
                    grad_move[a, b] = (weight[:, None] * both * ((y[:, None] == a) * (a == b) - edge)).sum()
            grad = np.concatenate([grad_emit.ravel(), grad_move.ravel()]) - prior / lines * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls(theta[:-4].reshape(-1, 2).copy(), theta[-4:].reshape(2, 2).copy())

    def viterbi(self, codes: list[int]) -> list[int]:
        """The most probable labels; of equal ones content."""
        (cc, cb), (bc, bb) = self.move.tolist()
        table = self._table()
        c, b = 0.0, 0.0
        came = []
        for i, code in enumerate(codes):
            ec, eb = table(code)
            if i:
                from_c, from_b = b + bc > c + cc, b + bb > c + cb
                came.append((from_c, from_b))
                c, b = (b + bc if from_c else c + cc) + ec, (b + bb if from_b else c + cb) + eb
            else:
                c, b = ec, eb
        labels = [BOILERPLATE if b > c else CONTENT] if codes else []
        for step in reversed(came):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def _table(self):
        if "_known" not in self.__dict__:
            self._known = {}

        def look(code: int) -> tuple[float, float]:
            if code not in self._known:
                self._known[code] = tuple((self.bits(np.array(code)) @ self.emit).tolist())
            return self._known[code]

        return look


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = 3000) -> LineField:
    """A field learned from at most ``sample_docs`` labelled documents, half of each class where there are as many.

    The sample is drawn by a hash of the id, so it is the same in every run. Its size bounds the broadcast and what the driver holds.
    """
    known = labels.select(F.col(doc_id).alias("key"), F.col(label).cast("int").alias("good")).where("key is not null and good in (0, 1)").distinct()
    half = [known.where(F.col("good") == g).orderBy(F.xxhash64("key"), "key").limit(sample_docs // 2) for g in (0, 1)]
    drawn = half[0].unionByName(half[1])

    @F.pandas_udf("array<int>")
    def codes(texts):
        return texts.map(lambda s: [c for c in read_lines(s or "")[1] if c >= 0])

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("value"))
    found = texts.join(F.broadcast(drawn), F.col("id") == F.col("key")).select("key", codes("value").alias("codes"), "good").toPandas()
    found = found.sort_values("key", kind="stable")
    return LineField.fit([(list(c), CONTENT if g else BOILERPLATE) for c, g in zip(found["codes"], found["good"]) if len(c)])


STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
         "line_labels string, content_share double, kept boolean")


def assess(docs: DataFrame, field: LineField, text: str = "text", keep: list[str] | None = None, min_words: int = 50, min_share: float = 0.5) -> DataFrame:
    """Every row of ``docs`` (of its columns ``keep``, or all) as struct ``row`` with its counts, line labels and verdict ``kept``."""

    def judge(text: str | None) -> tuple:
        text = text or ""
        by_line, codes, repeats = read_lines(text)
        words = [w for line in by_line for w in line]
        n, again = len(words), repeat_words(words)
        raw = b"".join(words)
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        failed = n < min_words or 100 * again > 50 * n
        labels = iter(field.viterbi([c for c in codes if c >= 0]))
        marks = ["-" if c < 0 else "cb"[next(labels)] for c in codes]
        content = sum(len(w) for w, mark in zip(by_line, marks) if mark == "c")
        share = content / n if n else 0.0
        return n, len(raw.decode("utf-8", "replace")), symbols, repeats, again, failed, "".join(marks), share, not failed and share >= min_share

    bound_batches(docs.sparkSession)

    @F.pandas_udf(STATS)
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(value) for value in texts], columns=[c.split()[0] for c in STATS.split(", ")])

    # Only the text goes to Python; the row stays in the JVM.
    done = packed(docs, keep, value=F.col(text)).withColumn("stats", judged("value"))
    return done.select("row", "stats.*")
