"""Operator 10, language ID by segmentation-marginalised unigrams.

A word's probability in a language is the sum over all its segmentations into pieces of a fixed public vocabulary (its
white-space marker stands for a word's start, and single bytes cover anything else) of the product of the pieces'
probabilities; a forward pass computes it. Piece probabilities are learned by expectation-maximisation over
the word counts of labelled documents. Words are lower-cased runs of letters; runs over 31 bytes are scored in
stretches of 31. Words never share a piece, so a text's score is the sum over its distinct words.

The model is fitted on every labelled document given for learning, and every document is scored.
Defined results: null or letterless text is `und` with score 0, as is everything when nothing is labelled;
equal texts get equal rows; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm.common import LETTER, LOWER, Members, blocks, cut, documents, spans, xxh64_spans
from twinframe.operators.quantiles import percentiles

EM_ROUNDS, MAX_PIECE, MAX_WORD = 4, 12, 31
#: words that a task of the fit learns from at a time
FIT_WORDS = 16384
#: the share of labelled documents' typical gain that a text must reach in keep_known
MIN_SHARE = 0.17
#: bytes of typical text added to each text, so that a word or two decide nothing, and what one word weighs at most
PRIOR_BYTES, WORD_BYTES = 6, 8
#: bytes of text that are scored at a time; a longer text stands alone
BLOCK = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(MAX_WORD + 1, _MUL)]), dtype=np.uint64)


def load_pieces(path: str | None = None, max_piece: int = MAX_PIECE) -> list[bytes]:
    """The vocabulary's pieces as lower-case bytes (word start: a space), and all single bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    usual = (model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    found = {b for p in usual if len(b := p.encode()) <= max_piece and b == b.lower() and b" " not in b[1:]}
    return sorted(found | {bytes([i]) for i in range(256)})


def _hash(pieces: list[bytes]) -> np.ndarray:
    out = []
    for p in pieces:
        h = 0
        for b in p:
            h = (h * int(_MUL) + b + 1) % 2**64
        out.append(h)
    return np.array(out, np.uint64)


class Lattice:
    """Sums over the segmentations of many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.sizes = sorted({len(p) for p in pieces})
        self.find = {n: (Members(_hash(own)), np.array(ids)) for n in self.sizes for ids, own in [zip(*[(i, p) for i, p in enumerate(pieces) if len(p) == n], strict=True)]}

    def arcs(self, words: np.ndarray, lengths: np.ndarray):
        """(end, piece length, words' rows, piece ids) of all pieces inside words; words: bytes, sorted by falling length."""
        n, width = words.shape
        h = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            h[i + 1] = h[i] * _MUL + words[:, i] + np.uint64(1)
        out = []
        for end in range(1, width + 1):
            live = int(np.searchsorted(-lengths, -end, "right"))
            for size in self.sizes:
                if size > end or not live:
                    break
                members, ids = self.find[size]
                rows, which = members.find(h[end, :live] - h[end - size, :live] * _POW[size])
                if len(rows):
                    out.append((end, size, rows, ids[which]))
        return out

    def forward(self, arcs, n: int, width: int, p: np.ndarray) -> np.ndarray:
        """(width + 1, n, languages): probability of each prefix."""
        alpha = np.zeros((width + 1, n, p.shape[1]))
        alpha[0] = 1
        for end, size, rows, ids in arcs:
            alpha[end, rows] += alpha[end - size, rows] * p[ids]
        return alpha

    def log_prob(self, words: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        alpha = self.forward(self.arcs(words, lengths), len(words), words.shape[1], p)
        return np.log(np.maximum(alpha[lengths, np.arange(len(words))], 1e-300))

    def expected(self, words: np.ndarray, lengths: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(pieces, languages): expected uses of each piece, given each word's counts by language."""
        n, width = words.shape
        arcs = self.arcs(words, lengths)
        alpha = self.forward(arcs, n, width, p)
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(n)] = counts / np.maximum(alpha[lengths, np.arange(n)], 1e-300)
        used, which = [np.zeros((0, p.shape[1]))], [np.zeros(0, np.int64)]
        for end, size, rows, ids in reversed(arcs):
            back = beta[end, rows] * p[ids]
            used.append(alpha[end - size, rows] * back)
            which.append(ids)
            beta[end - size, rows] += back
        used, which = np.concatenate(used), np.concatenate(which)
        return np.stack([np.bincount(which, used[:, k], self.size) for k in range(p.shape[1])], axis=1)


def _cut_long(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs in stretches of MAX_WORD bytes: starts, ends, whether a word begins there, and each run's number of stretches."""
    k = np.maximum(1, -(-(ends - starts) // MAX_WORD))
    run = np.repeat(np.arange(len(starts)), k)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(k) - k, k)
    s = starts[run] + nth * MAX_WORD
    return s, np.minimum(s + MAX_WORD, ends[run]), nth == 0, k


def _matrix(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the stretches (a space before a word's first), sorted by falling length; lengths; order."""
    lengths = ends - starts + first
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, first = starts[order], lengths[order], first[order]
    width = int(lengths[0]) if len(lengths) else 0
    col = np.arange(width)
    at = np.clip(starts[:, None] + col - first[:, None], 0, max(len(buf) - 1, 0))
    out = np.where(col < lengths[:, None], buf[at], 0).astype(np.uint8)
    if width:
        out[first, 0] = 32
    return out, lengths, order


def _words(buf: np.ndarray, offsets: np.ndarray):
    """Distinct stretches of a block: (starts, ends, first), each stretch's distinct index, and its text."""
    buf = LOWER[buf]
    starts, ends, of = spans(buf, offsets, LETTER)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
    s, e, first, k = _cut_long(starts, ends)
    key = xxh64_spans(buf, s, e - s) ^ first.astype(np.uint64)
    _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
    return buf, s[index], e[index], first[index], inverse, np.repeat(text, k)


def _beside_digit(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each stretch of _words is of a run of letters that touches a digit of its text, as keys and hexadecimal numbers do."""
    starts, ends, of = spans(buf, offsets, LETTER)
    digit = np.append((buf >= 48) & (buf <= 57), False)
    before = digit[starts - 1] & (starts > np.repeat(offsets[:-1], np.diff(of)))
    after = digit[ends] & (ends < np.repeat(offsets[1:], np.diff(of)))
    return np.repeat(before | after, _cut_long(starts, ends)[3])


def word_counts(labelled: DataFrame) -> DataFrame:
    """(text, lang) -> (lang, word, n): counts of the stretches, word starts marked by a space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in blocks(batches, "text"):
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            buf, s, e, first, inverse, text = _words(raw, offsets)
            lang = np.array([names.index(x) for x in langs])[text]
            pair, n = np.unique(inverse * len(names) + lang, return_counts=True)
            word = [(b" " if f else b"") + buf[a:b].tobytes() for a, b, f in zip(s, e, first, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in pair % len(names)], pa.string()), pa.array([word[i] for i in pair // len(names)], pa.binary()), pa.array(n)], ["lang", "word", "n"])

    return labelled.select("lang", "text").mapInArrow(task, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, rounds: int = EM_ROUNDS, vocabulary: str | None = None) -> tuple[list[str], np.ndarray, list[bytes], np.ndarray]:
    """docs (text, lang), all of them for learning: languages, piece probabilities, pieces, log priors."""
    pieces = load_pieces(vocabulary)
    counts = cut(word_counts(docs.where("lang is not null and text is not null")), "words")
    share = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(share)
    p = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(rounds if langs else 0):

        def task(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces), np.zeros((len(pieces), len(langs)))

            def learn(rows: pa.Table) -> None:
                lang = np.array([langs.index(x) for x in rows.column("lang").to_pylist()])
                words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
                for k in np.unique(lang):
                    at = np.flatnonzero(lang == k)
                    own = [words[i] for i in at]
                    lengths = np.array([len(w) for w in own])
                    ends = np.cumsum(lengths)
                    m, lengths, order = _matrix(np.frombuffer(b"".join(own), np.uint8), ends - lengths, ends, np.zeros(len(own), bool))
                    total[:, k] += lattice.expected(m, lengths, p[:, k : k + 1], n[at[order], None])[:, 0]

            held, size = [], 0
            for batch in batches:
                for lo in range(0, batch.num_rows, FIT_WORDS):
                    held.append(batch.slice(lo, FIT_WORDS))
                    size += held[-1].num_rows
                    if size >= FIT_WORDS:
                        learn(pa.Table.from_batches(held))
                        held, size = [], 0
            if size:
                learn(pa.Table.from_batches(held))
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(total[i, k])], ["piece", "lang", "n"])

        got = counts.mapInArrow(task, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # vocabulary x languages
        total = np.full(p.shape, 0.01)
        total[got.piece, got.lang] += got.n
        p = total / total.sum(axis=0)
    prior = np.log(np.array([share[x] for x in langs], float) / max(1, sum(share.values()))) if langs else np.zeros(0)
    return langs, p, pieces, prior


def against_none(model, spelled: float = 0.05):
    """The model with letters of its own in each language (a share `spelled` goes to single bytes, by their shares in the language's
    pieces), the piece probabilities of no language (bytes alone: half dealt to those that the learned languages use, half to all),
    and which bytes those are. Real words of a language that no piece holds are then spelled by its letters."""
    langs, p, pieces, prior = model
    of = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
    at = {x: i for i, x in enumerate(pieces)}
    single, data = np.array([at[bytes([i])] for i in range(256)]), np.frombuffer(b"".join(pieces), np.uint8)

    def letters(weights: np.ndarray) -> np.ndarray:
        share = np.bincount(data, weights[of], 256)
        return share / max(share.sum(), 1e-300)

    seen = p - p.min(axis=0)  # without what every piece has, seen or not
    out = (1 - spelled) * p
    for k in range(p.shape[1]):
        out[single, k] += spelled * letters(seen[:, k])
    used = letters(seen @ np.exp(prior)) > 1e-5
    none = np.zeros(len(pieces))
    none[single] = 0.5 * used / max(1, used.sum()) + 0.5 / 256
    return langs, out, pieces, prior, none, used


def _score(docs: DataFrame, model, text_col: str, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns c0, c1, ... for those of `keep`, then lang_, score_, gain_ and bytes_ (see keep_known); the names c0, c1, ...

    The model may be one of `against_none`; else gain_ and bytes_ are 0.
    """
    langs, p, pieces, prior, *rest = model
    p = np.column_stack([p, *rest[:1]])
    names = [f"c{i}" for i in range(len(keep))]
    at = names[keep.index(text_col)] if text_col in keep else "text_"
    plain = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], *([] if text_col in keep else [docs[text_col].alias(at)]))
    schema = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)]).schema.add("lang_", "string").add("score_", "double").add("gain_", "double").add("bytes_", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for part, raw, offsets in blocks(batches, at, BLOCK):
            n = len(offsets) - 1
            buf, s, e, first, inverse, text = _words(raw, offsets)
            total, gain, judged = np.tile(prior, (n, 1)), np.zeros(n), np.zeros(n, np.int64)
            if len(s) and langs:
                logs = np.empty((len(s), p.shape[1]))
                for lo in range(0, len(s), 8192):
                    m, lengths, order = _matrix(buf, s[lo : lo + 8192], e[lo : lo + 8192], first[lo : lo + 8192])
                    logs[lo + order] = lattice.log_prob(m, lengths, p)
                for k in range(len(langs)):
                    total[:, k] += np.bincount(text, logs[inverse, k], n)
                if rest:
                    size = e - s
                    strange = np.concatenate([[0], np.cumsum(~rest[1][buf])])
                    foreign = 3 * (strange[e] - strange[s]) >= size  # by byte values alone
                    ratio = (logs[inverse, total.argmax(axis=1)[text]] - logs[inverse, -1]) / size[inverse]
                    weight = np.where(_beside_digit(buf, offsets), 0, np.minimum(size, WORD_BYTES)[inverse])
                    gain = np.bincount(text, weight * np.where(foreign[inverse], -1, np.maximum(ratio, -1)), n)
                    judged = np.bincount(text, weight, n).astype(np.int64)
            letters = np.zeros(n, bool)
            letters[text[(buf[s] < 128)[inverse]]] = True
            for i in np.flatnonzero(~letters & (np.bincount(text, minlength=n) > 0)):
                letters[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace"))
            if langs:
                best = total.argmax(axis=1)
                score = np.where(letters, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                found = [langs[b] if x else "und" for b, x in zip(best, letters, strict=True)]
            else:
                found, score = ["und"] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(found, pa.string()), pa.array(score), pa.array(gain), pa.array(judged)], [*names, "lang_", "score_", "gain_", "bytes_"])

    return plain.mapInArrow(task, schema), names


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row."""
    found, (doc_id,) = _score(docs, model, text_col, [id_col])
    return found.select(F.col(doc_id).alias("doc_id"), F.col("lang_").alias("lang_pred"), F.col("score_").alias("score"))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def typical(scored: DataFrame) -> float:
    """The median gain by byte over the labelled documents that are held out of the fit, or over all labelled ones where none is."""
    own = scored.where("lang is not null and text is not null and bytes_ > 0").select(held_out(F.col("doc_id")).alias("held_out"), (F.col("gain_") / F.col("bytes_")).alias("x"))
    found = {r.held_out: r.value for r in percentiles(own, "x", [0.5], ["held_out"]).collect()}
    return found.get(True, found.get(False, 0.0))


def keep_known(docs: DataFrame, min_score: float = 0.3, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents' columns, without documents of no language, of a score under `min_score`, or of no learned language.

    The score weighs the learned languages against each other only, so it is near 1 for any longer text. Each word is therefore
    also weighed under the found language against no language (see against_none): its gain in log probability by byte, -1 at
    least and for a word of bytes that no learned language uses; words beside digits, as in keys, don't count. A text's gain is
    the mean over its words by their bytes (WORD_BYTES at most) and PRIOR_BYTES bytes of typical text. It doesn't grow with the length,
    and must reach `min_share` of the typical gain: the median over all labelled documents held out of the fit (over all of those in
    it where none is held out). Where nothing is labelled, no document stays.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    if not model[0]:
        return docs.limit(0)
    found, names = _score(docs, against_none(model), "text", docs.columns)
    found = cut(found, "scored")
    usual = typical(found.select(*[F.col(names[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text", "lang")], "gain_", "bytes_"))
    gain = (F.col("gain_") + PRIOR_BYTES * usual) / (F.col("bytes_") + PRIOR_BYTES)
    known = (F.col("lang_") != "und") & (F.col("score_") >= min_score) & (gain >= min_share * usual)
    return found.where(known).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(docs.doc_id)).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
