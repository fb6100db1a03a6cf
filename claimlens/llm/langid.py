"""Language identification of words by a linear-chain conditional random field.

Each word (a run of letters, digits and other non-ASCII characters with at least one
letter) is a position; its label is a language. Potentials of a word:

* affixes and character n-grams: the UTF-8 n-grams (2, 3, 4 bytes) of the word between
  boundary marks, hashed to ``FEATURES`` weights a language; those that hold a mark are its
  prefixes and suffixes;
* lexicon: per language, the log of the word's hashed frequency in that language, counted
  over all training documents.

Transitions between languages are learned with the word weights by gradient steps on
the conditional likelihood. Training sequences are spliced from passages of
different documents, so they hold language switches.

Marginals come from forward-backward. Texts are cut into segments of ``SEGMENT``
words: all segments' transfer matrices are multiplied up together, the few
segments of a text are chained, and every word gets its exact marginals. A text's
language has the largest sum of marginals; the score is that language's mean.

Training takes at most ``SAMPLE`` documents of each language (smallest hash of the id; of several texts of
an id the one with the smallest hash) of up to ``SAMPLE_CHARS`` characters; lexicon counts cover every training document. Tasks get the weights, some
megabytes whatever the input's size. Nothing but the text is read in a prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the
language first in order; repeated rows each give a row; without training
documents all is ``und``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import ALNUM_WORDS, arrow_map, ragged
from claimlens.llm.tokens import text_slices, word_hashes

UNDETERMINED = "und"
FEATURES = 1 << 16
LEXICON = 1 << 16
#: Documents a language, and characters of one, that the weights are learned from at most.
SAMPLE, SAMPLE_CHARS = 500, 200_000
SEGMENT = 32
#: Training: words in all, words a passage, passages a sequence, gradient steps and their length.
TRAIN_WORDS, PASSAGE, PASSAGES, STEPS, RATE, DECAY = 200_000, 24, 6, 40, 0.15, 1e-6

# --- words and features -------------------------------------------------------------


def lettered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of the words with a letter, how many each text has, and the distinct words."""
    numbers: dict[bytes, int] = {}
    number, parts = numbers.setdefault, []
    for t in texts:
        words = t.translate(ALNUM_WORDS).split()
        parts.append(np.fromiter((number(w, len(numbers)) for w in words), np.int32, len(words)))
    words = list(numbers)
    letter = np.array([any(map(str.isalpha, w.decode())) for w in words], bool)
    new = np.cumsum(letter) - 1
    parts = [new[p[letter[p]]] for p in parts] if words else parts
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), sizes, [w for w, x in zip(words, letter) if x]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and the end of each word's range."""
    marked = b"".join(b"^" + w + b"$" for w in words)
    a = np.frombuffer(marked, np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(a))  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    grams, owners, code = [], [], a.copy()
    for n in (2, 3, 4):
        code = code[:-1] * np.uint64(257) + a[n - 1:] if len(code) else code
        inside = np.flatnonzero(left[: len(code)] >= n)
        h = (code[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append((h >> np.uint64(48)).astype(np.int64) % FEATURES)
        owners.append(owner[inside])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.cumsum(np.bincount(owners, minlength=len(words)))


def lexicon_buckets(words: list[bytes]) -> np.ndarray:
    return (word_hashes(words, 1) % np.uint64(LEXICON)).astype(np.int64)


# --- forward-backward ---------------------------------------------------------------


def forward_backward(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray,
                     pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Marginals of every position of sequences laid end to end; summed pair marginals if
    asked for; and each sequence's log normaliser.

    ``emit``, ``trans`` and ``start`` are log potentials.
    """
    n, k = emit.shape
    sizes = sizes.astype(np.int64)
    top = emit.max(axis=1, initial=-np.inf) if n else np.zeros(0)
    psi, a, pi = np.exp(emit - top[:, None]), np.exp(trans), np.exp(start)
    full = np.flatnonzero(sizes)
    count = -(-sizes[full] // SEGMENT)
    begin = np.repeat((np.cumsum(sizes) - sizes)[full], count) + ragged(np.zeros(len(full), np.int64), count) * SEGMENT
    end = np.minimum(begin + SEGMENT, np.repeat(np.cumsum(sizes)[full], count))
    lengths, first = end - begin, np.cumsum(count) - count
    heads = np.zeros(len(begin), bool)
    heads[first] = True

    # Transfer matrix of each segment; a sequence's first has the start vector in every row.
    m = np.tile(np.eye(k), (len(begin), 1, 1))
    for s in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > s)
        step = m[live] @ a
        if s == 0:
            step[heads[live]] = pi
        step *= psi[begin[live] + s][:, None, :]
        m[live] = step / step.max(axis=(1, 2), keepdims=True)

    into, out = np.zeros((len(begin), k)), np.ones((len(begin), k))
    into[first, 0] = 1
    for j in range(1, int(count.max(initial=0))):
        at = first[count > j] + j
        v = np.einsum("ik,ikl->il", into[at - 1], m[at - 1])
        into[at] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(count.max(initial=0)) - 1, 0, -1):
        at = first[count > j] + j
        v = np.einsum("ikl,il->ik", m[at], out[at])
        out[at - 1] = v / v.max(axis=1, keepdims=True)

    alpha, beta, norm = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    now = into.copy()
    for s in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > s)
        v = now[live] @ a
        if s == 0:
            v[heads[live]] = pi
        v *= psi[begin[live] + s]
        z = v.sum(axis=1)
        now[live] = alpha[begin[live] + s] = v / z[:, None]
        norm[begin[live] + s] = np.log(z) + top[begin[live] + s]
    now = out.copy()
    for s in range(int(lengths.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(lengths > s)
        at = begin[live] + s
        beta[at] = now[live]
        v = (psi[at] * now[live]) @ a.T
        now[live] = v / v.max(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    both = None
    if pairs:
        later = np.ones(n, bool)
        later[(np.cumsum(sizes) - sizes)[full]] = False
        at = np.flatnonzero(later)
        p = alpha[at - 1][:, :, None] * a[None] * (psi[at] * beta[at])[:, None, :]
        both = (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    # Without the start's scale the first step's normaliser is complete; later ones follow it.
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return gamma, both, np.bincount(owner, norm, len(sizes))


# --- the model ----------------------------------------------------------------------


@dataclass
class Tagger:
    languages: list[str]
    lexicon: np.ndarray  # (LEXICON, k) log frequencies
    grams: np.ndarray  # (FEATURES, k)
    mix: np.ndarray  # (k, k) weights of the lexicon's languages
    trans: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)))
        out = self.lexicon[lexicon_buckets(words)] @ self.mix
        grams, ends = word_features(words)
        for k in range(len(self.languages)):
            out[:, k] += np.add.reduceat(self.grams[grams, k], np.concatenate(([0], ends[:-1])))
        return out

    def marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the words of all texts, and words per text."""
        ids, sizes, words = lettered_words(texts)
        if not len(ids):
            return np.zeros((0, len(self.languages))), sizes
        return forward_backward(self.emissions(words)[ids], sizes, self.trans, self.start)[0], sizes

    def runs(self, text: bytes) -> list[tuple[int, int, str]]:
        """(first word, end, language) of the stretches of words with the same best language."""
        best = self.marginals([text])[0].argmax(axis=1)
        cuts = np.flatnonzero(np.diff(best)) + 1
        edges = [0, *cuts.tolist(), len(best)]
        return [(s, e, self.languages[best[s]]) for s, e in zip(edges, edges[1:]) if e > s]


def fit(texts: list[bytes], labels: list[str], lexicon: np.ndarray, languages: list[str], seed: int = 11) -> Tagger:
    """Learns all weights; ``lexicon`` has log frequencies."""
    k, rng = len(languages), np.random.default_rng(seed)
    tagger = Tagger(languages, lexicon, np.zeros((FEATURES, k)), np.eye(k) * 0.5, np.zeros((k, k)), np.zeros(k))
    ids, sizes, words = lettered_words(texts)
    if not len(ids):
        return tagger
    begin = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    language = np.array([languages.index(x) for x in labels])
    # Passages from languages in turn, so that every switch occurs; a few sequences stay in one document.
    by = [full[language[full] == c] for c in range(k)]
    by = [d for d in by if len(d)]
    position, truth, lengths = [], [], []
    while sum(lengths) < TRAIN_WORDS:
        total = 0
        for _ in range(PASSAGES):
            docs = by[rng.integers(len(by))]
            d = docs[rng.integers(len(docs))]
            n = min(int(rng.integers(1, 2 * PASSAGE)), int(sizes[d]))
            at = begin[d] + rng.integers(sizes[d] - n + 1)
            position.append(np.arange(at, at + n))
            truth.append(np.full(n, language[d]))
            total += n
        lengths.append(total)
    word, y, lengths = ids[np.concatenate(position)], np.concatenate(truth), np.array(lengths)
    used, word = np.unique(word, return_inverse=True)
    chosen = [words[i] for i in used]
    grams, ends = word_features(chosen)
    starts = np.concatenate(([0], ends[:-1]))
    lex, owner = lexicon[lexicon_buckets(chosen)], np.repeat(np.arange(len(chosen)), ends - starts)
    head = np.cumsum(lengths) - lengths
    later = np.ones(len(y), bool)
    later[head] = False
    at = np.flatnonzero(later)
    observed = np.bincount(y[at - 1] * k + y[at], minlength=k * k).reshape(k, k)
    params = [tagger.grams, tagger.mix, tagger.trans, tagger.start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        emit = lex @ tagger.mix
        for c in range(k):
            emit[:, c] += np.add.reduceat(tagger.grams[grams, c], starts)
        gamma, both, _ = forward_backward(emit[word], lengths, tagger.trans, tagger.start, pairs=True)
        over = -gamma
        over[np.arange(len(y)), y] += 1
        per = np.stack([np.bincount(word, over[:, c], len(chosen)) for c in range(k)], 1)
        slopes = [
            np.stack([np.bincount(grams, per[owner, c], FEATURES) for c in range(k)], 1),
            lex.T @ per, observed - both, over[head].sum(axis=0),
        ]
        for p, g, u, v in zip(params, slopes, first, second):  # Adam
            g = g / len(y) - DECAY * p
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            p += RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger


# --- jobs ---------------------------------------------------------------------------


def lexicon_counts(docs: DataFrame, languages: list[str], text_col: str, lang_col: str) -> np.ndarray:
    """Words per (bucket, language) over all training documents; tasks add up before the shuffle."""
    place, k = {c: i for i, c in enumerate(languages)}, len(languages)
    names = [f"c{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEXICON * k, np.int64)
        for batch in batches:
            of = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for at, texts in text_slices(batch, 0):
                ids, sizes, words = lettered_words(texts)
                if len(ids):
                    cell = lexicon_buckets(words)[ids] * k + np.repeat(of[at:at + len(texts)], sizes)
                    total += np.bincount(cell, minlength=LEXICON * k)
        table = total.reshape(LEXICON, k)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), *(pa.array(table[some, i]) for i in range(k))], ["bucket", *names])

    sums = arrow_map(docs.select(text_col, lang_col), run, ", ".join(["bucket int", *(f"{n} long" for n in names)])).groupBy("bucket").agg(
        *[F.sum(n).alias(n) for n in names])
    counts = np.zeros((LEXICON, k))
    for r in sums.collect():  # one row a bucket
        counts[r["bucket"]] = [r[n] for n in names]
    return counts


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Tagger:
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    short = rows.filter(F.length(text_col) <= SAMPLE_CHARS)
    ids = short.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")).filter("__id IS NOT NULL").distinct()
    h = F.xxhash64("__id")
    # Ids per language and top bits of their hash tell up to which bits ``sample`` ids are found; only
    # those are ranked, so a language with most of the rows is no task's burden.
    tops = ids.groupBy("__lang", F.shiftright(h, 48).alias("__top")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("__lang").orderBy("__top")) - F.col("n")
    cuts = tops.withColumn("before", before).filter(F.col("before") < sample).groupBy("__lang").agg(F.max("__top").alias("__cut"))
    near = ids.join(F.broadcast(cuts), "__lang").filter(F.shiftright(h, 48) <= F.col("__cut"))  # one row a language
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy(h, "__id"))
    picked = F.broadcast(near.withColumn("__k", rank).filter(F.col("__k") <= sample).select("__id", "__lang"))
    got = short.join(picked, (short[id_col] == picked["__id"]) & (short[lang_col] == picked["__lang"])).groupBy("__id", "__lang").agg(
        F.min_by(F.col(text_col), F.xxhash64(text_col)).alias("t")).orderBy("__lang", "__id").collect()
    languages = sorted({r["__lang"] for r in got})
    if not languages:
        return Tagger([], np.zeros((LEXICON, 0)), np.zeros((FEATURES, 0)), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    counts = lexicon_counts(rows.filter(F.col(lang_col).isin(languages)), languages, text_col, lang_col)
    lexicon = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * LEXICON))
    lexicon -= lexicon.mean(axis=1, keepdims=True)
    return fit([r.t.encode() for r in got], [r["__lang"] for r in got], lexicon, languages)


def _judged(tagger: Tagger, batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, ...]:
    """Best language (number; the last for none), score, words and switches of each row."""
    n = batch.num_rows
    best, score = np.full(n, len(tagger.languages)), np.zeros(n)
    many, switches = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for first, texts in text_slices(batch, column) if tagger.languages else []:
        gamma, sizes = tagger.marginals(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        sums = np.stack([np.bincount(owner, gamma[:, k], len(texts)) for k in range(gamma.shape[1])], 1)
        some = np.flatnonzero(sizes)
        best[first + some] = sums[some].argmax(axis=1)
        score[first + some] = np.minimum(1.0, sums[some].max(axis=1) / sizes[some])
        many[first:first + len(texts)] = sizes
        label = gamma.argmax(axis=1)
        turn = np.flatnonzero((label[1:] != label[:-1]) & (owner[1:] == owner[:-1]))
        switches[first:first + len(texts)] = np.bincount(owner[turn], minlength=len(texts))
    return best, score, many, switches


def predict(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_words, n_switches) of each row. No shuffle."""
    names = np.array([*tagger.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, many, switches = _judged(tagger, batch, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(many), pa.array(switches)],
                [id_col, "lang_pred", "score", "n_words", "n_switches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col),
        run, f"`{id_col}` {kind}, lang_pred string, score double, n_words long, n_switches long")


def keep(docs: DataFrame, tagger: Tagger, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, with all their columns, whose text has a language; where ``lang_col`` is null, it is
    that language. No shuffle."""
    names = np.array([*tagger.languages, None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, *_ = _judged(tagger, batch, batch.schema.names.index(text_col))
            if lang_col in batch.schema.names and batch.column(at := batch.schema.names.index(lang_col)).null_count:
                arrays = list(batch.columns)
                arrays[at] = pc.coalesce(arrays[at], pa.array(names[best].tolist(), arrays[at].type))
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch.filter(pa.array(best < len(tagger.languages)))

    return arrow_map(docs, run, docs.schema)
