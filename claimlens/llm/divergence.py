"""How the sources of a language differ in their words, by a transducer vocabulary.

Terms are runs of letters A-Z (lower-cased) and of non-ASCII characters. ``vocabulary``
counts in how many documents of its language each term occurs, keeps those in at least
``MIN_DOCS``, sorts them over the cluster and numbers them (``ordinal``: place in UTF-8 order
within the language). ``transducers`` makes a minimal acyclic transducer of every ``PART``
consecutive terms. ``recount`` streams all whole texts through them, which gives the
ordinal of every kept term that occurs; ``audit`` compares sources by those counts.

Shares are whole numbers of 10^-9: p = 1 + floor(10^9 (count + 1) / (N + V)), N the group's
kept terms in all, V the language's kept terms. The divergence of p from q at a
term is floor((p - q)^2 / q). All arithmetic is exact: the division is long division in
three steps of 1000, so nothing passes 64 bits while N + V is below 9 * 10^15.

Scale. Nothing of the vocabulary is collected: terms are counted, sorted and numbered by
shuffles, and a language of any size is many parts. The transducers travel to the tasks
``FLEET_BYTES`` at a time; a vocabulary over that takes further passes over the text (a part is some 60
bytes a state, so one pass holds about a million terms at the default; raise it with the
executors' memory). A task adds up its counts, so a source with a third of all rows moves
one row a term and task. Shares are compared in blocks of ``BLOCK`` terms, each with all the
language's sources; a task adds up its blocks' sums and keeps ``top`` terms a source.

Defined results: null text, lang and source are ''; each row is a document, also one that repeats;
a group without terms has N = 0 and every share 1 + floor(10^9 / V); a language without kept
terms (V = 0) has pairs of value 0 and no terms; a lone source has no pairs; an empty
table gives no rows; other columns are ignored. Ties go by UTF-8 order: by ordinal for
terms, by name for sources.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import arrow_map, written
from claimlens.llm.tokens import text_slices
from claimlens.llm.transducer import Fleet, build

MIN_DOCS = 3
PART = 1 << 16
FLEET_BYTES = 96 << 20
BLOCK = 4096

#: Terms, (group, ordinal) pairs and sums of pairs a task holds before it hands them on.
HELD_TERMS, HELD_COUNTS, HELD_PAIRS = 150_000, 500_000, 1_000_000
#: Texts that walk through the transducers together.
SLICE_BYTES = 1 << 20

#: Lower-cases A-Z; every other ASCII byte becomes a space.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_IN_TERM = np.array([b != 32 for b in range(256)])


def _read(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return docs.select(plain(text_col).alias("text"), plain(lang_col).alias("lang"), plain(source_col).alias("source"))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["lang", "term", "n"])

    counts: dict[str, dict[bytes, int]] = {}
    held = 0
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, texts in text_slices(batch, 0):
            for i, t in enumerate(texts):
                own = counts.setdefault(langs[first + i], {})
                before, get = len(own), own.get
                for w in set(t.translate(TERMS).split()):
                    own[w] = get(w, 0) + 1
                held += len(own) - before
            if held > HELD_TERMS:
                yield from rows(counts)
                counts, held = {}, 0
    yield from rows(counts)


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, ordinal, term) of the kept terms; ``docs`` has text, lang and source without nulls."""
    counted = arrow_map(docs.select("text", "lang"), _document_counts, "lang string, term binary, n long")
    kept = written(counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term"), "kept")
    place = F.monotonically_increasing_id()
    tall = written(
        kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").select(
            "lang", "term", F.shiftright(place, 33).alias("slice"), place.alias("place")), "sorted")
    # The rows of a language in one slice are consecutive; slices follow the order of the terms.
    runs = tall.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("lang", "slice", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = tall.join(runs, ["lang", "slice"])
    return written(placed.select("lang", (F.col("offset") + F.col("place") - F.col("first")).alias("ordinal"), "term"), "vocabulary")


def transducers(terms: DataFrame, part: int = PART) -> DataFrame:
    """(lang, first ordinal, number of terms, size, packed transducer) of every ``part`` consecutive terms."""

    def made(table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        t = build(table.column("term").to_pylist())
        packed = zlib.compress(pickle.dumps(t), 1)
        return pa.table({"lang": table.column("lang")[:1].cast(pa.string()), "first": table.column("ordinal")[:1].cast(pa.int64()),
                         "n": pa.array([t.n], pa.int64()), "size": pa.array([t.nbytes], pa.int64()), "packed": pa.array([packed], pa.binary())})

    blocks = terms.withColumn("part", F.floor(F.col("ordinal") / part).cast("long")).groupBy("lang", "part")
    return written(blocks.applyInArrow(made, "lang string, first long, n long, size long, packed binary"), "transducers")


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, start and end of each term, and each term's text."""
    data = np.frombuffer(b" ".join([*(t.translate(TERMS) for t in texts), b""]), np.uint8)
    inside = _IN_TERM[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(begins, starts, "right") - 1


class _Counter:
    """Counts per (group, ordinal), summed as they come."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.counts, self.size = [], [], 0

    def add(self, group: np.ndarray, ordinal: np.ndarray) -> None:
        keys, counts = np.unique((group << 40) | ordinal, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > HELD_COUNTS:
            self.merge()

    def merge(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.counts = [np.bincount(at, np.concatenate(self.counts)).astype(np.int64)]
        self.keys, self.size = [keys], len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self.merge()
            of, names = self.keys[0] >> 40, list(self.groups)
            lang, source = (pa.array([g[k] for g in names], pa.string()).take(pa.array(of)) for k in (0, 1))
            whole = pa.RecordBatch.from_arrays(
                [lang, source, pa.array(self.keys[0] & ((1 << 40) - 1)), pa.array(self.counts[0])], ["lang", "source", "ordinal", "n"])
            for at in range(0, whole.num_rows, 100_000):
                yield whole.slice(at, 100_000)
        self.__init__()


def recount(docs: DataFrame, made: DataFrame, fleet_bytes: int = FLEET_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): the occurrences of every kept term in each group, from whole texts
    streamed through the transducers, ``fleet_bytes`` of them a pass."""
    spark, told = docs.sparkSession, None
    sizes = made.select("lang", "first", "size").orderBy("lang", "first").collect()  # one row for PART terms
    passes, room = [], 0
    for r in sizes:
        if not passes or r["size"] > room:
            passes.append([])
            room = fleet_bytes
        passes[-1].append((r["lang"], r["first"]))
        room -= r["size"]
    for chosen in passes:
        of = spark.createDataFrame(chosen, "lang string, first long")
        packed = made.join(F.broadcast(of), ["lang", "first"], "left_semi").select("lang", "first", "packed").collect()  # fleet_bytes at most
        langs = {lang: i for i, lang in enumerate(sorted({r["lang"] for r in packed}))}
        carried = spark.sparkContext.broadcast([(langs[r["lang"]], r["first"], bytes(r["packed"])) for r in packed])
        del packed

        def run(batches: Iterator[pa.RecordBatch], langs=langs, carried=carried) -> Iterator[pa.RecordBatch]:
            fleet = Fleet([(lang, first, pickle.loads(zlib.decompress(t))) for lang, first, t in carried.value])
            counter = _Counter()
            for batch in batches:
                rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                for first, texts in text_slices(batch, 0, SLICE_BYTES):
                    own = rows[first:first + len(texts)]
                    data, starts, ends, owner = terms_of(texts)
                    number = counter.groups.setdefault
                    group = np.array([number(g, len(counter.groups)) for g in own], np.int64)
                    lang = np.array([langs.get(g[0], -1) for g in own], np.int64)[owner]
                    for v in np.unique(lang):
                        at = np.flatnonzero(lang == v)
                        ordinal = fleet.ordinals(int(v), data, starts[at], ends[at])
                        found = ordinal >= 0
                        if found.any():
                            counter.add(group[owner[at[found]]], ordinal[found])
                if counter.size > HELD_COUNTS:
                    yield from counter.rows()
            yield from counter.rows()

        counted = arrow_map(docs.select("text", "lang", "source"), run, "lang string, source string, ordinal long, n long")
        counted = written(counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recounted")
        carried.destroy()
        told = counted if told is None else told.unionByName(counted)
    return told if told is not None else spark.createDataFrame([], "lang string, source string, ordinal long, n long")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) by long division; count + 1 is at most total."""
    rest, got = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        got = got * 1000 + digit
        rest = rest - digit * total
    return got + 1


class _Language:
    """Sums over the blocks of one language that a task has seen."""

    def __init__(self, lang: str, sources: list[str], top: int):
        self.lang, self.sources, self.top = lang, sources, top
        self.pairs = np.zeros((len(sources), len(sources)), np.int64) if len(sources) ** 2 <= HELD_PAIRS else None
        self.terms = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(sources)

    def block(self, counts: np.ndarray, totals: np.ndarray, ordinals: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``counts``: sources x terms; ``totals``: N + V of each source and of the language."""
        p = shares(counts, totals[:-1, None])
        q = shares(counts.sum(axis=0), totals[-1:])
        for a in range(len(self.sources)):
            off = p[a] - p
            sums = (off * off // p).sum(axis=1)
            if self.pairs is not None:
                self.pairs[a] += sums
            else:
                yield from self._pairs(a, sums)
            at = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            off = p[a][at] - q[at]
            value = np.concatenate((self.terms[a][0], off * off // q[at]))
            ordinal = np.concatenate((self.terms[a][1], ordinals[at]))
            best = np.lexsort((ordinal, -value))[:self.top]
            self.terms[a] = value[best], ordinal[best]

    def _rows(self, source: str, other: list[str | None], ordinal: list | np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        n = len(value)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(other, pa.string()),
             pa.array(ordinal, pa.int64()), pa.array(value, pa.int64())], ["lang", "source", "other", "ordinal", "value"])

    def _pairs(self, a: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        others = self.sources[:a] + self.sources[a + 1:]
        if others:
            yield self._rows(self.sources[a], others, [None] * len(others), np.delete(sums, a))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a, source in enumerate(self.sources):
            if self.pairs is not None:
                yield from self._pairs(a, self.pairs[a])
            if len(self.terms[a][0]):
                yield self._rows(source, [None] * len(self.terms[a][0]), self.terms[a][1], self.terms[a][0])


def _compare(top: int, step: int):
    """Partial sums of pairs and best terms, from rows sorted by (lang, block): the sources of the
    language (with totals) and their counts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language: _Language | None = None

        def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal language
            total = np.array(table.column("total").fill_null(-1))
            names = np.array(table.column("source").to_pylist(), object)
            head = total >= 0
            order = np.argsort([s.encode() for s in names[head]], kind="stable")
            sources, totals = [names[head][i] for i in order], total[head][order]
            lang = table.column("lang")[0].as_py()
            if language is None or language.lang != lang:
                if language is not None:
                    yield from language.rows()
                language = _Language(lang, sources, top)
            place = {s: i for i, s in enumerate(sources)}
            row = np.array([place[s] for s in names[~head]], np.int64)
            ordinal, n = (np.array(table.column(c).fill_null(0))[~head] for c in ("ordinal", "n"))
            used, column = np.unique(ordinal, return_inverse=True)
            every = np.concatenate((totals, np.array(table.column("everywhere").fill_null(0))[head][:1]))
            # A language of many sources is compared in narrower strips.
            width = max(1, min(step, (1 << 22) // max(1, len(sources))))
            for at in range(0, len(used), width):
                inside = (column >= at) & (column < at + width)
                counts = np.zeros((len(sources), min(width, len(used) - at)), np.int64)
                counts[row[inside], column[inside] - at] = n[inside]
                yield from language.block(counts, every, used[at:at + width])

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, number = batch.column("lang").to_pylist(), np.array(batch.column("block"))
            turn = np.flatnonzero((number[1:] != number[:-1]) | (np.array(lang[1:], object) != np.array(lang[:-1], object))) + 1
            for s, e in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows]):
                piece = pa.Table.from_batches([batch.slice(s, e - s)])
                if held and (held[-1].column("lang")[0].as_py(), held[-1].column("block")[0].as_py()) != (lang[s], int(number[s])):
                    yield from block(pa.concat_tables(held))
                    held = []
                held.append(piece)
        if held:
            yield from block(pa.concat_tables(held))
        if language is not None:
            yield from language.rows()

    return run


def audit(docs: DataFrame, top: int = 200, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", part: int = PART, fleet_bytes: int = FLEET_BYTES, step: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): per source its divergence from each other source of the
    language (part ``pair``, all ranks) and its ``top`` most telling terms against the language (``term``)."""
    docs = _read(docs, text_col, lang_col, source_col)
    terms = vocabulary(docs, min_docs)
    counts = recount(docs, transducers(terms, part), fleet_bytes)
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).join(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["n", "v"])
    groups = written(groups, "groups", small=True)
    whole = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    last = F.greatest(F.ceil(F.col("v") / step).cast("long") - 1, F.lit(0))
    heads = groups.join(whole, "lang").select(
        "lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.lit(None).cast("long").alias("ordinal"),
        F.lit(None).cast("long").alias("n"), (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("everywhere"))
    cells = counts.select("lang", "source", F.floor(F.col("ordinal") / step).cast("long").alias("block"), "ordinal", "n",
                          F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("everywhere"))
    dealt = heads.unionByName(cells).repartition("lang", "block").sortWithinPartitions("lang", "block")
    found = written(arrow_map(dealt, _compare(top, step), "lang string, source string, other string, ordinal long, value long"), "compared")

    pairs = found.filter("ordinal IS NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value",
                         F.row_number().over(by.orderBy(F.desc("value"), "other")).alias("rank"))
    best = found.filter("ordinal IS NOT NULL").withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "ordinal"))).filter(
        F.col("rank") <= top)
    named = best.join(terms, ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pairs.unionByName(named)
