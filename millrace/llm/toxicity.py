"""Toxicity scores from the nearest labelled examples.

``fit`` takes a bounded sample of labelled texts (``max_examples`` of each label, chosen by a hash
of the id; copies of a text count once) and makes

* a vocabulary: all words and word beginnings of the sample, with their inverse document
  frequencies.  Those that go with label 1 (chi-squared above 10.83, in at least ``LEAST_SEEN``
  texts) have their full weight, all others ``COMMON`` of it.  Texts that hold some of the former are
  near to examples that hold them too, all other texts to those that share most of their words.
  Words that no example has count as one term with the weight ``COMMON``;
* an inverted index of the examples' unit TF-IDF vectors in blocks of ``block`` points (examples with
  equal vectors are one): for each block the largest weight of each heavy term (block-max) and the
  largest length of the light part.  Heavy and frequent terms are columns, rare ones posting lists;
* a calibration of votes to probabilities, from the examples' own leave-one-out votes.

``score`` finds, for each text, the ``k`` points of largest cosine exactly: the two blocks of the
highest upper bounds (query times block-max, plus the product of the light lengths) are opened
first, then those whose bound reaches the k-th cosine so far, for many texts together; what may be
among the ``k`` in single precision is computed again in double.  Labels vote with weights that grow
as the distance shrinks; points that share no term don't vote.

One task builds the index from the counts of at most ``2 * max_examples`` texts and writes it into the
shared folder: columns (four bytes for each point), posting lists and bounds.  The driver holds its name
alone; workers memory-map it.

Defined results
---------------
* Terms are runs of letters, lower-cased, and the first five letters of longer ones with a ``^``.
* A text without words (null, empty, digits alone) has the zero vector; its cosine is 1 with
  examples that have the zero vector too; without such examples its score is the share of label 1.
* Of equal cosines (to six digits) the point with the smaller example id is nearer.
* Without labelled rows, or with labels of one kind only, all scores are the share of label 1
  (0.0 where nothing is labelled).
* Labels other than 0 and 1, null ids and labelled ids without a text are left out of fitting; an
  id that is labelled 0 and 1 counts as 1.  Of rows with one id and different texts each is an example.
  To meet the labels ids are cast to 64-bit integers; others are an error.
* Every row gives one row, also where ids repeat; other columns do not matter.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import sha256
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K

MAX_EXAMPLES, K_NEAREST, BLOCK = 4_000, 15, 64
LEAST_SEEN, LEAST_CHI, COMMON = 3, 10.83, 0.02
#: Terms in more than this share of the points are columns.  Single precision may be off by SLACK.  Posting lists are read for more than MANY points.
FREQUENT, SLACK, MANY = 0.05, 1e-5, 64
#: Characters of texts whose words are looked up in one go.
TOGETHER = 500_000
_words = re.compile(r"[^\W\d_]+").findall


def terms(text: str | None) -> Counter:
    words = Counter(_words((text or "").lower()))
    for w, n in list(words.items()):
        if len(w) > 5:
            words["^" + w[:5]] += n
    return words


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, label -> id, label and counts of the text's terms."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 50):
            batch = whole.slice(lo, 50)
            found = [terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))],
                ["id", "label", "term", "n"])


def counts(text: str | None, vocabulary: dict[str, int]) -> list[tuple[int, int]]:
    """(term, occurrences) of a text, in order; term 0 is all words without a term of their own."""
    _, feature, n = found([text], vocabulary)
    return list(zip(feature.tolist(), n.tolist(), strict=True))


def found(texts: list[str | None], vocabulary: dict[str, int], beginning: np.ndarray | None = None, together: int = TOGETHER) -> Rows:
    """The texts' terms, in order, and their occurrences; texts are taken in groups of about ``together`` characters.

    ``beginning``: of each word of the vocabulary its beginning, or 0.
    """
    get, parts = vocabulary.get, [(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    cuts = np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // together)) + 1
    for lo, hi in pairwise([0, *cuts.tolist(), len(texts)]):
        held = [Counter(_words((t or "").lower())) for t in texts[lo:hi]]
        words = list(chain.from_iterable(held))
        row = np.repeat(np.arange(len(held)) << 32, np.fromiter(map(len, held), np.int64, len(held)))
        n = np.fromiter(chain.from_iterable(x.values() for x in held), np.int64, len(words))
        own = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        start = np.zeros(len(words), np.int64) if beginning is None else beginning[own].astype(np.int64)
        for x in np.flatnonzero(own == 0).tolist() if beginning is not None else range(len(words)):
            if len(words[x]) > 5:
                start[x] = get("^" + words[x][:5], 0)
        itself, begun = (own > 0) | (start == 0), start > 0
        key, n = np.concatenate((row[itself] + own[itself], row[begun] + start[begun])), np.concatenate((n[itself], n[begun]))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[first], np.add.reduceat(n, first) if len(first) else n
        parts.append((parts[-1][0][-1] + np.searchsorted(key, np.arange(1, len(held) + 1) << 32), key & 0xFFFFFFFF, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # where each row starts, features, weights


def _spread(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of the rows ``of``, one row behind the other, and how many each has."""
    size = start[of + 1] - start[of]
    return np.arange(size.sum()) + np.repeat(start[of] - (np.cumsum(size) - size), size), size


class Index:
    """Block-max index of labelled examples, and the calibration of their votes.

    Examples with equal vectors are one point, whose label is their share of label 1 (as if the
    sample had the labels' true shares).  Points that are alike share blocks.  Terms 1 to ``heavy``
    are those that go with label 1.
    """

    def __init__(self, heavy: int, idf: np.ndarray, ids: list[int], labels: list[int], counted: Rows, k: int, block: int, share: float):
        self.names, self.heavy = pa.array([], pa.string()), heavy
        self.idf = np.concatenate(([COMMON], idf[:heavy], COMMON * idf[heavy:]))
        self.k, self.block, self.share = k, block, share
        points: dict[tuple, list] = {}
        start, feature, n = counted
        weight = self.unit(*counted)[2]
        for d, (i, y) in enumerate(zip(ids, labels, strict=True)):
            f, w = feature[start[d] : start[d + 1]], weight[start[d] : start[d + 1]]
            key = tuple(f[: np.searchsorted(f, heavy, "right")].tolist()), sha256(f.astype(np.int32).tobytes() + np.rint(w * 1e6).astype(np.int32).tobytes()).digest() if len(f) else b""
            point = points.setdefault(key, [0, 0, i, d])
            point[1 - y] += 1
            if i < point[2]:
                point[2:] = i, d
        zero = points.pop(((), b""), None)
        order = [points[x] for x in sorted(points)]
        self.n1, self.n0, self.example, rows = (np.array([x[c] for x in order], np.int64) for c in range(4))
        ones, noughts = sum(labels), len(labels) - sum(labels)
        self.w1, self.w0 = share / max(1, ones), (1 - share) / max(1, noughts)
        self.label = self._share(self.n1, self.n0)
        self.zero = self._share(*zero[:2]) if zero else share
        self.rank = np.argsort(np.argsort(self.example, kind="stable"), kind="stable")
        at, size = _spread(start, rows)
        self.start, self.feature, self.n = np.concatenate(([0], np.cumsum(size))), feature[at].astype(np.int32), n[at].astype(np.int32)
        del points, order, feature, weight, at, counted, n
        self._arrange()
        self.steps = [(0.0, 0.0), (1.0, 1.0)]
        if ones and noughts and len(rows):
            self._calibrate()

    #: What is stored of an index: arrays, which workers map, and the rest.
    ARRAYS = {
        "start": "<i8", "feature": "<i4", "weight": "<f8", "column": "<i8", "columns": "<f4", "post": "<i8", "post_point": "<i4", "post_weight": "<f4", "rare": "<f8", "bound": "<f4", "light": "<f8", "idf": "<f8",
        "n1": "<i8", "n0": "<i8", "example": "<i8", "rank": "<i8", "label": "<f8",
    }
    REST = ("heavy", "k", "block", "share", "w1", "w0", "zero", "steps")

    def save(self, folder: str) -> None:
        K.write_arrays(folder, "index", [getattr(self, x).astype(kind).reshape(-1) for x, kind in self.ARRAYS.items()])
        _io.write_file(folder, "rest", [pickle.dumps({x: getattr(self, x) for x in self.REST})])

    @classmethod
    def load(cls, folder: str) -> Index:
        self = cls.__new__(cls)
        self.__dict__.update(pickle.loads(_io.read_file(folder, "rest")))
        self.__dict__.update(zip(cls.ARRAYS, K.mapped_arrays(folder, "index", tuple(cls.ARRAYS.values())), strict=True))
        n = len(self.example)
        self.columns = self.columns.reshape(-1, n) if n else self.columns.reshape(int((self.column >= 0).sum()), 0)
        self.bound = self.bound.reshape(-1, self.heavy) if self.heavy else np.zeros((-(-n // self.block), 0), np.float32)
        terms = _io.read_file(folder, "terms")
        self.names = pickle.loads(terms) if terms else pa.array([], pa.string())
        return self

    @cached_property
    def terms(self) -> list[str]:
        return ["*", *self.names.to_pylist()]

    def name(self, term: int) -> str:
        return self.names[int(term) - 1].as_py() if term else "*"

    @cached_property
    def vocabulary(self) -> dict[str, int]:
        return {w.as_py(): i for i, w in enumerate(self.names, 1)}

    @cached_property
    def beginning(self) -> np.ndarray:
        """Of each word its beginning, or 0."""
        return np.array([0, *(self.vocabulary.get("^" + w[:5], 0) if len(w) > 5 else 0 for w in self.vocabulary)], np.int32)

    def _arrange(self) -> None:
        n, self.weight = len(self.start) - 1, self.unit(self.start, self.feature, self.n)[2]
        point = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.start))
        often = np.bincount(self.feature, minlength=len(self.idf)) > FREQUENT * n
        often[1 : self.heavy + 1] = True
        #: Of each term its column, or -1; and the columns.
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.columns = np.zeros((int(often.sum()), n), np.float32)
        held = self.column[self.feature] >= 0
        self.columns[self.column[self.feature[held]], point[held]] = self.weight[held]
        rare = np.flatnonzero(~held).astype(np.int32)
        rare = rare[np.argsort(self.feature[rare], kind="stable")]
        self.post = np.concatenate(([0], np.cumsum(np.bincount(self.feature[rare], minlength=len(self.idf)))))
        self.post_point, self.post_weight = point[rare], self.weight[rare].astype(np.float32)
        self.rare = np.sqrt(np.bincount(point[rare], self.weight[rare] ** 2, minlength=n))
        #: By block: the largest weight of each heavy term, and the largest length of the light part.
        blocks = np.arange(0, n, self.block)
        self.bound = np.maximum.reduceat(self.columns[self.column[1 : self.heavy + 1]], blocks, axis=1).T if n else np.zeros((0, self.heavy), np.float32)
        light = np.sqrt(np.bincount(point, np.where(self.feature > self.heavy, self.weight, 0.0) ** 2, minlength=n))
        self.light = np.maximum.reduceat(light, blocks) if n else np.zeros(0)

    @property
    def posting(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By block: its terms, and for each of them the weights of the block's points."""
        out = []
        for lo in range(0, len(self.example), self.block):
            own = np.arange(lo, min(lo + self.block, len(self.example)))
            at, size = _spread(self.start, own)
            held, place = np.unique(self.feature[at], return_inverse=True)
            weights = np.zeros((len(held), len(own)))
            weights[place, np.repeat(own - lo, size)] = self.weight[at]
            out.append((held, weights))
        return out

    def _share(self, n1, n0):
        return n1 * self.w1 / np.maximum(n1 * self.w1 + n0 * self.w0, 1e-300)

    def unit(self, start: np.ndarray, feature: np.ndarray, n: np.ndarray) -> Rows:
        """TF-IDF vectors of length 1, of counts."""
        raw = n * self.idf[feature]
        row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        return start, feature, raw / np.sqrt(np.bincount(row, raw * raw, minlength=len(start) - 1))[row]

    def matrix(self, vectors: list[tuple]) -> np.ndarray:
        """Unit vectors of counts, as rows."""
        start = np.concatenate(([0], np.cumsum([len(v) for v in vectors], dtype=np.int64)))
        feature, n = (np.array([x[c] for v in vectors for x in v], np.int64) for c in (0, 1))
        start, feature, weight = self.unit(start, feature, n)
        out = np.zeros((len(vectors), len(self.idf)))
        out[np.repeat(np.arange(len(vectors)), np.diff(start)), feature] = weight
        return out

    def nearest(self, queries: np.ndarray | Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Points and cosines of the k nearest points of each query, exactly; -1 where there are fewer."""
        if isinstance(queries, np.ndarray):
            row, feature = np.nonzero(queries)
            queries = np.searchsorted(row, np.arange(len(queries) + 1)), feature, queries[row, feature]
        start, feature, weight = queries
        at, cosine = np.full((len(start) - 1, k), -1, np.int64), np.zeros((len(start) - 1, k))
        for lo in range(0, len(at) if len(self.example) else 0, 128):
            hi = min(lo + 128, len(at))
            own = slice(start[lo], start[hi])
            self._search(start[lo : hi + 1] - start[lo], feature[own], weight[own], at[lo:hi], cosine[lo:hi])
        return at, cosine

    def _search(self, start: np.ndarray, feature: np.ndarray, weight: np.ndarray, at: np.ndarray, cosine: np.ndarray) -> None:
        m, n, k = len(at), len(self.example), at.shape[1]
        row = np.repeat(np.arange(m), np.diff(start))
        query = np.zeros((m, len(self.columns)), np.float32)
        held = self.column[feature] >= 0
        query[row[held], self.column[feature[held]]] = weight[held]
        light = np.sqrt(np.bincount(row, np.where(feature > self.heavy, weight, 0.0) ** 2, minlength=m))
        rare = np.sqrt(np.bincount(row[~held], weight[~held] ** 2, minlength=m))
        upper = query[:, self.column[1 : self.heavy + 1]] @ self.bound.T + light[:, None] * self.light
        near = np.full((m, n), -1.0, np.float32)

        def open_blocks(wanted: np.ndarray) -> None:
            if wanted.mean() > 0.25:  # one product is faster than many, and more cosines do no harm
                near[:] = query @ self.columns
                return
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows, points = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                near[rows, points] = query[rows] @ self.columns[:, points]

        def kth(of: np.ndarray) -> np.ndarray:
            return np.partition(of, -k, axis=-1)[..., -k] if of.shape[-1] >= k else np.full(of.shape[:-1], -1.0)

        best = np.argsort(-upper, axis=1)[:, :2]
        first = np.zeros(upper.shape, bool)
        np.put_along_axis(first, best, True, axis=1)
        open_blocks(first)
        points = (best[:, :, None] * self.block + np.arange(self.block)).reshape(m, -1)
        least = kth(np.where(points < n, np.take_along_axis(near, np.minimum(points, n - 1), axis=1), -1.0))
        open_blocks(~first & (upper + SLACK >= least[:, None]))
        # Cosines without the rare terms so far: they can add the product of the rare parts' lengths at most.
        least = kth(near)
        space = np.zeros(len(self.idf))

        def exact(points: np.ndarray) -> np.ndarray:
            own = zip(self.start[points].tolist(), self.start[points + 1].tolist(), strict=True)
            return np.fromiter((space.take(self.feature[a:b], mode="clip").dot(self.weight[a:b]) for a, b in own), np.float64, len(points))

        for d in range(m):
            own = slice(start[d], start[d + 1])
            space[feature[own]] = weight[own]
            reach = near[d] + rare[d] * self.rare
            points = np.flatnonzero((reach >= least[d] - SLACK) & (near[d] > -1))
            if len(points) > 2 * k:
                some = points[np.argpartition(-near[d, points], k)[:k]]
                points = points[reach[points] >= exact(some).min() - SLACK]
            if len(points) > MANY:
                f, w = feature[own][~held[own]], weight[own][~held[own]]
                post, size = _spread(self.post, f)
                whole = np.where(near[d] > -1, near[d] + np.bincount(self.post_point[post], np.repeat(w, size) * self.post_weight[post], minlength=n), -1.0)
                points = np.flatnonzero((whole >= kth(whole) - SLACK) & (whole > -1))
            key = np.rint(np.minimum(exact(points), 1.0) * 1e6)
            space[feature[own]] = 0.0
            best = np.lexsort((self.rank[points], -key))[:k]
            at[d, : len(best)], cosine[d, : len(best)] = points[best], key[best] / 1e6

    def votes(self, at: np.ndarray, cosine: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Labels weighted by 1 / (distance + 0.05)."""
        w = np.where((at < 0) | (cosine <= 0), 0.0, 1.0 / (1.05 - cosine))
        total = w.sum(axis=1)
        return np.where(total > 0, (w * label).sum(axis=1) / np.maximum(total, 1e-300), self.share)

    def _calibrate(self) -> None:
        """Isotonic regression of the labels on leave-one-out votes."""
        pairs: list[list[float]] = []
        for lo in range(0, len(self.example), 1024):
            own = np.arange(lo, min(lo + 1024, len(self.example)))
            to = slice(self.start[lo], self.start[own[-1] + 1])
            at, cosine = self.nearest((self.start[lo : own[-1] + 2] - self.start[lo], self.feature[to], self.weight[to]), self.k + 1)
            for y, n in ((1, self.n1[own]), (0, self.n0[own])):
                label = self.label[at]
                mine = at == own[:, None]
                left = self._share(np.maximum(self.n1[own] - y, 0), np.maximum(self.n0[own] - (1 - y), 0))
                label = np.where(mine, left[:, None], label)
                alone = mine & ((self.n1 + self.n0)[own] == 1)[:, None]
                vote = self.votes(np.where(alone, -1, at), cosine, label)
                pairs += [[v, y * m * self.w1, m * (self.w1 if y else self.w0)] for v, m in zip(vote.tolist(), n.tolist(), strict=True) if m]
        pools: list[list[float]] = []  # sum of votes times weights, label weights, weights
        for v, y, w in sorted(pairs):
            pools.append([v * w, y, w])
            while len(pools) > 1 and (pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        tiny = min(self.w1, self.w0)
        self.steps = [(v / w, (y + tiny * self.share) / (w + tiny)) for v, y, w in pools]

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        xs, ys = zip(*self.steps, strict=True)
        return np.clip(np.interp(votes, xs, ys), 0.0, 1.0)

    def score(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """Score and evidence of each text."""
        out: list[tuple[float, str]] = []
        for lo in range(0, len(texts), 512):
            part = texts[lo : lo + 512]
            start, feature, weight = queries = self.unit(*found(part, self.vocabulary, self.beginning))
            at, cosine = self.nearest(queries, self.k)
            score = self.calibrated(self.votes(at, cosine, self.label[at] if len(self.label) else np.zeros(at.shape)))
            for d, v in enumerate((start[1:] > start[:-1]).tolist()):
                near = ",".join(f"{self.example[a]}:{c:.3f}:{self.label[a]:.2f}" for a, c in zip(at[d, :3].tolist(), cosine[d, :3].tolist(), strict=True) if a >= 0)
                f, w = feature[start[d] : start[d + 1]], weight[start[d] : start[d + 1]]
                top = ",".join(self.name(f[x]) for x in np.lexsort((f, -w))[:3].tolist())
                out.append((float(score[d]) if v else float(self.zero), f"{near if v else ''}|{top}"))
        return out


@dataclass(frozen=True)
class Fitted:
    """Where an index is stored."""

    folder: str

    def load(self) -> Index:
        return _loaded(self.folder)


@lru_cache(maxsize=1)
def _loaded(folder: str) -> Index:
    return Index.load(folder)


def _store_terms(folder: str):
    """Terms in the order of their numbers -> their file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("feature", pa.int32()), ("term", pa.string())]))
        if held.num_rows:
            _io.write_file(folder, "terms", [pickle.dumps(held.sort_by("feature").column("term").combine_chunks())])
            yield pa.RecordBatch.from_arrays([pa.array([held.num_rows], pa.int64())], ["terms"])

    return run


def _build(heavy: int, k: int, block: int, share: float, folder: str):
    """Counts of all examples -> the index's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            build(pa.Table.from_batches(held), heavy, k, block, share).save(folder)
            yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in held)], pa.int64())], ["examples"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES,
        k: int = K_NEAREST, block: int = BLOCK) -> Fitted:
    """``labels``: id and label, of the rows that may be learnt from.  At most 2 * max_examples ids are used."""
    spark = docs.sparkSession
    _io.bounded_batches(spark)
    given = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    given = given.groupBy("id").agg(F.max("label").alias("label"))
    count = {r.label: r["count"] for r in given.groupBy("label").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    picked = [r for y in (0, 1) for r in given.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(max_examples).collect()]
    sample = F.broadcast(spark.createDataFrame([(r.id, r.label) for r in picked], "id bigint, label int"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(sample, "id")
    texts = texts.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min_by(F.struct("id", "text", "label"), "id").alias("r")).select("r.*")
    counted = _io.materialise(texts.select("id", "text", "label").mapInArrow(K.giving_back(_terms), "id bigint, label int, term array<string>, n array<int>"), "examples")
    held = counted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1")).first()
    ranked = _io.materialise(numbered(counted, held["n"], held["n1"]), "terms")
    heavy = ranked.where("goes").count()
    each = counted.select("id", "label", F.explode_outer(F.arrays_zip("term", "n")).alias("e")).select("id", "label", "e.term", F.col("e.n").alias("n"))
    each = each.join(ranked.select("term", "feature"), "term", "left").groupBy("id", "label").agg(F.sort_array(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "n")))).alias("e"))
    each = each.select("id", "label", F.col("e.feature").alias("feature"), F.col("e.n").alias("n"))
    folder = _io.qualified(spark, _io.scratch(spark, "toxicity-index"))
    ranked.select("feature", "term").repartition(1).mapInArrow(_store_terms(folder), "terms bigint").collect()
    if not each.repartition(1).mapInArrow(K.giving_back(_build(heavy, k, block, share, folder)), "examples bigint").collect():
        build(pa.table({"id": pa.array([], pa.int64()), "label": pa.array([], pa.int32())}), 0, k, block, share).save(folder)
    return Fitted(folder)


def numbered(counted: DataFrame, n: int, n1: int) -> DataFrame:
    """term, feature (from 1 on), goes: those that go with label 1 first, by chi-squared, then the others by name."""
    n0 = n - n1
    terms = counted.select("label", F.explode("term").alias("term")).groupBy("term").agg(F.count_if(F.col("label") == 1).cast("double").alias("a"), F.count_if(F.col("label") == 0).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    off = a * (n0 - b) - b * (n1 - a)
    chi = F.lit(float(n)) * off * off / F.greatest((a + b) * (n - a - b) * float(max(n1, 1)) * float(max(n0, 1)), F.lit(1e-300))
    terms = terms.select("term", chi.alias("chi"), ((off > 0) & (a + b >= LEAST_SEEN) & (a + b < n) & (chi > LEAST_CHI)).alias("goes"))
    by = Window.orderBy(~F.col("goes"), F.when(F.col("goes"), -F.round("chi", 6)).otherwise(0.0), "term")
    return terms.select("term", F.row_number().over(by).alias("feature"), "goes")  # in one task: the terms of a bounded sample


def build(sample: pa.Table, heavy: int, k: int = K_NEAREST, block: int = BLOCK, share: float = 0.5) -> Index:
    """``sample``: id, label, feature and n (sorted lists) of different texts; features up to ``heavy`` go with label 1."""
    ids, labels = sample.column("id").to_pylist(), sample.column("label").to_pylist()
    features, ns = (pa.array([], pa.list_(pa.int32())) if not sample.num_rows else sample.column(c).combine_chunks() for c in ("feature", "n"))
    start = np.concatenate(([0], np.cumsum(pc.list_value_length(features).to_numpy(zero_copy_only=False).astype(np.int64))))
    feature, n = features.flatten().to_numpy(zero_copy_only=False), ns.flatten().to_numpy(zero_copy_only=False)
    seen = np.bincount(feature, minlength=1)[1:]
    return Index(heavy, np.log((1 + len(ids)) / (1 + seen)) + 1, ids, labels, (start, feature, n), k, block, share)


class Scorer:
    """Scores of texts; equal texts are searched once while they are remembered."""

    def __init__(self, index: Index):
        self.index, self.known = index, {}

    def of(self, texts: list[str | None]) -> list[tuple[float, str]]:
        if len(self.known) > 20_000:
            self.known.clear()
        keys = [sha256((t or "").encode()).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.known}
        self.known.update(zip(new, self.index.score(list(new.values())), strict=True))
        return [self.known[k] for k in keys]


def _score(index: Fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index.load())
        for batch in batches:
            scores = scorer.of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in scores], pa.float64()), pa.array([e for _, e in scores], pa.string())], ["id", "score", "evidence"])

    return run


def _clean(index: Fitted, column: int):
    """Whole rows in, those of texts that score less than 0.5 out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index.load())
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s, _ in scorer.of(batch.column(column).cast(pa.string()).to_pylist())], pa.bool_()))

    return run


def score(docs: DataFrame, index: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, evidence: the three nearest points as example:cosine:label share, then the text's heaviest terms."""
    _io.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(K.giving_back(_score(index), _loaded), f"id {docs.schema['id'].dataType.simpleString()}, score double, evidence string")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def production_index(docs: DataFrame, labels: DataFrame) -> Fitted:
    return fit(docs, labels.where(~held_out()))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, production_index(docs, labels)).select(
        F.col("id").alias("doc_id"), F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts aren't predicted toxic, with all their columns; each row by its own text, without a shuffle."""
    index = production_index(docs, labels)
    return docs.mapInArrow(K.giving_back(_clean(index, docs.columns.index(text_col)), _loaded), docs.schema)
