"""Language-model scoring over a subword lattice.

The model is a unigram model over the pieces of an existing vocabulary: a word
(marked at its start) can be cut into pieces in many ways, each way has the
product of its pieces' probabilities, and the word's probability is the sum over
all ways, by forward recursion in log space.  A text is the product of its words
and of one end.  The public vocabulary file at hand stores merge ranks as
scores, so the ranks give first weights (a Zipf law) and one round of
expectation-maximisation over all training words (expected piece counts from the
same lattice) fits them to the corpus; the vocabulary itself stays as it is.

Work per distinct word, not per occurrence: words are counted map-side and by
Spark, scored once each, and given back to the documents.  Words that make up
more than ``1 / HOT`` of all words, of which there are fewer than HOT, are
broadcast; all others are joined, one row per document and word.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import Scratch

MARK = "▁"                  # the vocabulary's sign for the start of a word
HOT, HOT_BYTES = 500_000, 64     # bound of the broadcast: fewer than HOT words of at most HOT_BYTES bytes
_FLUSH = 250_000                 # distinct words that a task holds before it passes their counts on
_LONG, _STRIDE = 48, 2048        # words above this length are taken one by one, others so many at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
LN10 = math.log(10.0)


def _utf8(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass")


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(texts), -1)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes modulo 2**64 of every prefix of each row."""
    h = np.zeros(codes.shape, np.uint64)
    run = np.zeros(codes.shape[0], np.uint64)
    for k in range(codes.shape[1]):
        run = (run + codes[:, k] + np.uint64(1)) * _BASE
        run = run ^ (run >> np.uint64(29))
        h[:, k] = run
    return h


def _by_length(words: list[str]):
    """(row numbers, code points behind the start mark) of words of one length; no code points for very long words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []:
        if lengths[rows[0]] > _LONG:
            yield rows, None
            continue
        for at in range(0, len(rows), _STRIDE):
            part = rows[at:at + _STRIDE]
            yield part, _codes([MARK + words[r] for r in part])


class Pieces:
    """Log probabilities of pieces; characters without a piece are spelled in byte pieces."""

    def __init__(self, weights: dict[str, float], byte_weights: list[float], end: float):
        total = sum(weights.values()) + sum(byte_weights) + end
        self.log = {p: math.log(w / total) for p, w in weights.items()}
        self.byte = [math.log(w / total) for w in byte_weights]
        self.end = math.log(end / total)
        self.longest = max(map(len, weights), default=1)
        self.names = list(self.log)
        self.number = {p: i for i, p in enumerate(self.names)}
        hashes = np.array([int(_hashes(_codes([p]))[0, -1]) for p in self.names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        self.filter = np.zeros(1 << 20, bool)                  # most substrings are no piece: one look tells
        self.filter[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.logs = np.array([self.log[p] for p in self.names])

    @classmethod
    def from_file(cls, path: str, offset: float = 10.0) -> "Pieces":
        """Zipf weights 1 / (rank + offset) from a sentencepiece file whose scores are minus the merge ranks."""
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        weights = {model.id_to_piece(i): 1.0 / (max(-model.get_score(i), 0.0) + offset) for i in range(n)
                   if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
                   and model.get_score(i) > -1e8}
        return cls(weights, [1.0 / (n + offset)] * 256, 1.0 / offset)

    def edges(self, text: str):
        """Per end position: (start, log probability, piece) of every piece that ends there."""
        log, longest = self.log, self.longest
        out = []
        for j in range(1, len(text) + 1):
            here = []
            for i in range(max(0, j - longest), j):
                lp = log.get(text[i:j])
                if lp is not None:
                    here.append((i, lp, text[i:j]))
                elif i == j - 1:
                    here.append((i, sum(self.byte[b] for b in text[i].encode("utf-8", "surrogatepass")), None))
            out.append(here)
        return out

    def forward(self, edges) -> list[float]:
        exp, log = math.exp, math.log
        alpha = [0.0]
        for here in edges:
            terms = [alpha[i] + lp for i, lp, _ in here]
            if len(terms) == 1:
                alpha.append(terms[0])
            else:
                top = max(terms)
                alpha.append(top + log(sum([exp(t - top) for t in terms])))
        return alpha

    def marginal(self, word: str) -> float:
        """ln of the summed probability of all segmentations of a word."""
        return self.forward(self.edges(MARK + word))[-1]

    def expected(self, word: str, count: float, into: dict) -> None:
        """Add ``count`` times the expected number of each piece (bytes by number) in a random segmentation."""
        text = MARK + word
        edges = self.edges(text)
        alpha = self.forward(edges)
        beta: list = [None] * len(alpha)
        beta[-1] = 0.0
        total, exp, log = alpha[-1], math.exp, math.log
        for j in range(len(text), 0, -1):
            b = beta[j]
            if b is None:
                continue
            for i, lp, piece in edges[j - 1]:
                t = lp + b
                old = beta[i]
                if old is None:
                    beta[i] = t
                elif old > t:
                    beta[i] = old + log(1.0 + exp(t - old))
                else:
                    beta[i] = t + log(1.0 + exp(old - t))
                share = count * exp(alpha[i] + t - total)
                if piece is not None:
                    into[piece] = into.get(piece, 0.0) + share
                else:
                    for x in text[i].encode("utf-8", "surrogatepass"):
                        into[x] = into.get(x, 0.0) + share

    # -- many words of one length at a time

    def _arcs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, length - 1, word]: log probability of the piece there (-inf: none) and its number (-1: bytes)."""
        words, n = codes.shape
        width = min(self.longest, n)
        lp = np.full((n, width, words), -np.inf)
        number = np.full((n, width, words), -1, np.int32)
        for i in range(n):
            h = _hashes(codes[:, i:i + width])
            row, at = np.nonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            keys = h[row, at]
            place = np.searchsorted(self.hashes, keys)
            place[place == len(self.hashes)] = 0
            hit = self.hashes[place] == keys
            row, at, piece = row[hit], at[hit], self.ids[place[hit]]
            lp[i, at, row] = self.logs[piece]
            number[i, at, row] = piece
            bare = np.flatnonzero(lp[i, 0] == -np.inf)
            if len(bare):
                chars, back = np.unique(codes[bare, i], return_inverse=True)
                spelled = np.array([sum(self.byte[b] for b in _utf8(c)) for c in chars])
                lp[i, 0, bare] = spelled[back]
        return lp, number

    def _forward(self, lp: np.ndarray) -> np.ndarray:
        n, width, words = lp.shape
        alpha = np.full((n + 1, words), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            for i in range(max(0, j - width), j):
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + lp[i, j - i - 1])
        return alpha

    def marginals(self, words: list[str]) -> np.ndarray:
        """``marginal`` of every word."""
        out = np.empty(len(words))
        for rows, codes in _by_length(words):
            if codes is None:
                out[rows] = [self.marginal(words[r]) for r in rows]
            else:
                out[rows] = self._forward(self._arcs(codes)[0])[-1]
        return out

    def expect(self, words: list[str], counts: np.ndarray, pieces: np.ndarray, chars: dict) -> None:
        """Add the expected counts of pieces by number, and of characters spelled in bytes by code point."""
        for rows, codes in _by_length(words):
            if codes is None:
                for r in rows:
                    into: dict = {}
                    self.expected(words[r], float(counts[r]), into)
                    for k, v in into.items():
                        if isinstance(k, str):
                            pieces[self.number[k]] += v
                        else:
                            chars[-1 - k] = chars.get(-1 - k, 0.0) + v
                continue
            lp, number = self._arcs(codes)
            n, width, many = lp.shape
            alpha = self._forward(lp)
            beta = np.full((n + 1, many), -np.inf)
            beta[n] = 0.0
            scale = np.log(counts[rows].astype(float)) - alpha[n]
            for i in range(n - 1, -1, -1):
                for k in range(min(width, n - i)):
                    arc = lp[i, k] + beta[i + k + 1]
                    beta[i] = np.logaddexp(beta[i], arc)
                    share = np.exp(alpha[i] + arc + scale)
                    known = number[i, k] >= 0
                    pieces += np.bincount(number[i, k][known], share[known], len(pieces))
                    if k == 0 and not known.all():
                        c, back = np.unique(codes[~known, i], return_inverse=True)
                        for x, v in zip(c.tolist(), np.bincount(back, share[~known]).tolist()):
                            chars[x] = chars.get(x, 0.0) + v

    def refit(self, counts: dict, ends: float, keep: float = 0.01) -> "Pieces":
        """New weights: expected counts, with ``keep`` of the old distribution mixed in."""
        total = sum(counts.values()) + ends
        old = keep / (1 - keep) * total if total else 1.0
        return Pieces({p: counts.get(p, 0.0) + old * math.exp(lp) for p, lp in self.log.items()},
                      [counts.get(i, 0.0) + old * math.exp(lp) for i, lp in enumerate(self.byte)],
                      ends + old * math.exp(self.end))


def held_out(id_: Column, folds: int = 7, fold: int = 2) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def _count_words(batches):
    """(word, train, every): counts of a stretch of documents, split between training and all of them."""
    train, held = Counter(), Counter()

    def table():
        only = [w for w in held if w not in train]
        n = list(train.values())
        out = pa.RecordBatch.from_arrays(
            [pa.array([*train, *only], pa.binary()), pa.array(n + [0] * len(only), pa.int64()),
             pa.array([k + held.get(w, 0) for w, k in train.items()] + [held[w] for w in only], pa.int64())],
            ["word", "train", "every"])
        train.clear()
        held.clear()
        return out

    for b in batches:
        for raw, out in zip(b.column(0), b.column(1).to_pylist()):
            # bytes: lower() takes A-Z only, split() splits at exactly \x20 and \x09-\x0D
            (held if out else train).update(raw.as_py().lower().split())
            if len(train) + len(held) > _FLUSH:
                yield table()
    if train or held:
        yield table()


def _expect(shared):
    def run(batches):
        model = shared.value
        pieces, chars = np.zeros(len(model.names)), {}
        for b in batches:
            words = [w.as_py().decode("utf-8", "replace") for w in b.column(0)]
            model.expect(words, np.asarray(b.column(1)), pieces, chars)
        used = np.flatnonzero(pieces)
        spelled: dict = {}
        for c, v in chars.items():                       # below 0: a byte counted as such
            for x in (_utf8(c) if c >= 0 else (-1 - c,)):
                spelled[x] = spelled.get(x, 0.0) + v
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.names[i] for i in used] + [""] * len(spelled), pa.string()),
             pa.array([-1] * len(used) + list(spelled), pa.int32()),
             pa.array(pieces[used].tolist() + list(spelled.values()), pa.float64())], ["piece", "byte", "n"])
    return run


def _marginals(shared):
    def run(batches):
        for b in batches:
            lp = shared.value.marginals([w.as_py().decode("utf-8", "replace") for w in b.column(0)]) / LN10
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp, pa.float64())], [*b.schema.names, "lm"])
    return run


ROWS = "kind int, row long, n_tokens long, n_known long, base double, lm double, word binary, n long"


def _score_documents(shared):
    """Kind 0: a row per document with the sums over hot words; kind 1: its other words, counted."""
    names = [x.split()[0] for x in ROWS.split(", ")] + ["doc_id", "held_out"]

    def run(batches):
        number, known, base, lm = shared.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            sums, words, counts, owners = np.zeros((4, size)), [], [], []
            for d, raw in enumerate(b.column(0)):
                found = raw.as_py().lower().split()
                c = Counter(found)
                n = np.fromiter(c.values(), np.int64, len(c))
                at = np.fromiter(map(number.get, c, repeat(-1)), np.int64, len(c))
                hot = at >= 0
                at, m = at[hot], n[hot]
                sums[:, d] = len(found) + 1, m @ known[at], m @ base[at], m @ lm[at]
                rare = ~hot
                words += compress(c, rare)
                counts.append(n[rare])
                owners.append(np.full(len(c) - len(at), row + d))
            none = lambda t, k=size: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(size, np.int32)), pa.array(np.arange(row, row + size)), pa.array(sums[0].astype(np.int64)),
                 pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), none(pa.binary()), none(pa.int64()),
                 b.column(1), b.column(2)], names)
            row += size
            counts, owners = np.concatenate(counts), np.concatenate(owners)
            for i in range(0, len(words), 100_000):
                part = words[i:i + 100_000]
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(k, np.int32)), pa.array(owners[i:i + k]), none(pa.int64(), k), none(pa.int64(), k),
                     none(pa.float64(), k), none(pa.float64(), k), pa.array(part, pa.binary()), pa.array(counts[i:i + k]),
                     none(b.column(1).type, k), none(pa.bool_(), k)], names)
    return run


def score(docs: DataFrame, *, vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model", text: str = "text",
          id_col: str = "doc_id", hold: Column | None = None, rounds: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Training and scoring use whole texts; ``hold`` marks documents that are
    scored but not learned from.

    Defined cases: a null text is empty, and an empty text is one end; a null id
    is passed on; repeated rows are scored and learned from as often as they
    occur; without training documents the first weights score and base counts
    are zero; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "lm")
    hold = held_out(docs[id_col]) if hold is None else hold
    d = docs.select(F.encode(F.coalesce(docs[text], F.lit("")), "UTF-8").alias("raw"), docs[id_col].alias("doc_id"),
                    F.coalesce(hold, F.lit(False)).alias("held_out"))
    counted = d.select("raw", "held_out").mapInArrow(_count_words, "word binary, train long, every long")
    words = scratch.write(counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "words")
    n_train, types, n_every = words.agg(F.sum("train"), F.count(F.when(F.col("train") > 0, 1)), F.sum("every")).first()
    ends = d.where(~F.col("held_out")).count()
    total, kinds = (n_train or 0) + ends, types + (1 if ends else 0)

    pieces = Pieces.from_file(vocabulary)
    for _ in range(rounds):
        got = (words.where("train > 0").select("word", "train")
               .mapInArrow(_expect(sc.broadcast(pieces)), "piece string, byte int, n double")
               .groupBy("piece", "byte").agg(F.sum("n").alias("n")).collect())          # one row per piece of the vocabulary
        pieces = pieces.refit({r["piece"] if r["byte"] < 0 else r["byte"]: r["n"]
                               for r in sorted(got, key=lambda r: (r["byte"], r["piece"]))}, float(ends))
    base = F.log10((F.col("train") + 1) / F.lit(float(total + kinds + 1)))
    values = scratch.write(words.mapInArrow(_marginals(sc.broadcast(pieces)), "word binary, train long, every long, lm double")
                           .withColumn("base", base).withColumn("known", (F.col("train") > 0).cast("long")), "values")
    # fewer than HOT words can each make up more than 1 / HOT of all words
    hot_if = (F.col("every") > (n_every or 0) / HOT) & (F.octet_length("word") <= HOT_BYTES)
    hot = values.where(hot_if).select("word", "known", "base", "lm").toArrow()
    hot = ({w: i for i, w in enumerate(hot["word"].to_pylist())}, *[hot[c].to_numpy() for c in ("known", "base", "lm")])
    id_type = d.schema["doc_id"].dataType.simpleString()
    rows = scratch.write(d.mapInArrow(_score_documents(sc.broadcast(hot)), f"{ROWS}, doc_id {id_type}, held_out boolean"), "rows")
    rare = (rows.where("kind = 1").select("row", "word", "n")
            .join(values.where(~hot_if).select("word", "known", "base", "lm"), "word")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("known")).alias("r_known"), F.sum(F.col("n") * F.col("base")).alias("r_base"),
                                F.sum(F.col("n") * F.col("lm")).alias("r_lm")))
    out = rows.where("kind = 0").drop("word", "n").join(rare, "row", "left")
    end_base = math.log10((ends + 1) / (total + kinds + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("r_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("lm") + F.coalesce("r_lm", F.lit(0.0)) + pieces.end / LN10).alias("score"))
