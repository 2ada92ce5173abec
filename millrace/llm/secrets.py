"""Secret scan by dictionary-primed zstandard novelty.

Three base patterns (assignments to sensitive names, access keys, long hexadecimal runs) are
always reported.  Beyond them, candidates are runs of token characters whose surrounding
holds a sensitive word.  For each candidate a zstandard compressor is primed with a dictionary of
identifiers and the surrounding text without the candidate and its copies; the bytes that the
candidate adds to the compressed form, for each of its characters, is its novelty.  Words, paths,
identifiers and repeated text compress well; random keys don't.  Candidates that add at least
``least`` of what their own characters add in chance order are reported with the kind ``novel``:
so neither a small alphabet nor a length from which zstandard codes literals hides a key.

Zstandard takes short words, words of letters alone and names with a few digits for novel, too.  So
candidates must also be spelt unlike words: their pairs of neighbours must cost at least ``LEAST_SPELT``
bits a character by the pairs of the language's own documentation (random letters cost 6 to 10, names 3 to
5.5).  Hexadecimal runs of 16 and more with digits and letters are never words.  What is not reported:
runs under 8 characters, runs without letters, and runs under 16 of letters alone without a small
letter before a capital.

The dictionary has two parts.  The names of a programming language (keywords, builtins, modules of the
standard library) and the sensitive words are the same for every table.  The corpus's own identifiers are
counted over all documents: names that are assigned, called or keyed, without digits and spelt like words,
in two documents at least; the ``dictionary`` most frequent are taken, which bounds what goes to the workers.
What a candidate is measured against is bounded by ``window`` characters on either side, whatever the
text's length.

Defined results
---------------
* A null text counts as empty and has no spans.  Every row gives one row, also where ids repeat;
  an empty table gives no rows; other columns do not matter.
* Base spans: leftmost, non-overlapping matches of each kind; matches that fail the kind's length
  are dropped, and the search goes on behind them.  Spans of different kinds may overlap.
* Novel spans overlap no base span and no other novel span.
* ``novelty``: bytes per character of each span, base ones too, in the order of ``spans``.
"""

from __future__ import annotations

import builtins
import keyword
import math
import re
import string
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import spans as S

KINDS = ("assign", "access", "hex", "novel")
#: Fixed by the contract.  re.A: case is ignored for ASCII letters only.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

NAMES = ("password", "passwd", "secret", "token", "api")
#: Words that make a surrounding sensitive.
CONTEXT = ("secret", "token", "passw", "credential", "private", "bearer", "auth", "api", "key", "akia", "pwd", "signature", "cookie", "session")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_sensitive = re.compile("|".join(CONTEXT)).search
_inner_capital = re.compile("[a-z][A-Z]").search
WINDOW, NEAR, LEAST_NOVELTY = 256, 48, 0.72
#: Shorter strings are stored as they are: a byte a character by chance.  Zstandard codes literals from 64 bytes on, the 16 before a candidate included.
CODED = 48
#: Hexadecimal candidates from LONG on are judged by novelty alone.  Copies share at least COPY characters.
LONG, LEAST_SPELT, COPY = 16, 6.0, 12


def base_spans(text: str) -> list[S.Span]:
    """Base spans by start, then kind as listed."""
    found: list[S.Span] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@lru_cache(maxsize=1)
def identifiers() -> bytes:
    """Names that code is made of; zstandard refers to them at little cost."""
    names = sorted({*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names, *dir(str), *dir(dict), *dir(list)})
    return (" ".join(names) + " " + " ".join(f'{c} = "' for c in (*NAMES, *CONTEXT)) + " 0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ").encode()


#: Names that are assigned, called or keyed.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_.-]{2,39}(?=[\"']?\x20{0,2}(?:[=:(]|=>))")
DICTIONARY = 2_000


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> identifiers, and in how many of the texts they are."""
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text and ("=" in text or ":" in text or "(" in text):
                seen.update({m for m in IDENTIFIER.findall(text) if spelt(m) < LEAST_SPELT})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["name", "n"])


def corpus_identifiers(texts: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The most frequent identifiers of a table's texts (one column), the most frequent last; at most ``most`` come to the driver."""
    names = texts.mapInArrow(_identifiers, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    return [r["name"] for r in names.orderBy(F.desc("n"), "name").limit(most).collect()][::-1]


class Novelty:
    def __init__(self, window: int = WINDOW, names: Iterable[str] = ()):
        import zstandard

        self.zstd, self.window = zstandard, window
        self.known = " ".join(names).encode() + b" " + identifiers()
        self.params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=15)

    def _around(self, text: str, start: int, end: int) -> tuple[str, str]:
        """The surroundings of text[start:end] without its copies, also those that other runs hold or that a window's edge cuts."""
        size = min(COPY, end - start)
        grams = {text[i : i + size] for i in range(start, end - size + 1)}
        sides = []
        for lo, hi in ((max(0, start - self.window), start), (end, min(len(text), end + self.window))):
            kept = list(text[lo:hi])
            for i in range(max(0, lo - size + 1), hi):
                # A copy may be cut by the window's edge, never by the candidate: that is a whole run.
                if text[i : i + size] in grams:
                    kept[max(0, i - lo) : max(0, i + size - lo)] = [""] * len(kept[max(0, i - lo) : max(0, i + size - lo)])
            sides.append("".join(kept))
        return sides[0], sides[1]

    def _added(self, text: str, start: int, end: int) -> Callable[[str], int]:
        """Compressed bytes that a string adds in the place of text[start:end], knowing names and surroundings."""
        left, right = self._around(text, start, end)
        tail = left[-16:].encode()
        primed = self.zstd.ZstdCompressionDict(self.known + b" " + (left + right).encode(), dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        squeeze = self.zstd.ZstdCompressor(dict_data=primed, compression_params=self.params).compress
        return lambda s: max(0, len(squeeze(tail + s.encode())) - len(squeeze(tail)))

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds, for each of its characters."""
        return self._added(text, start, end)(text[start:end]) / (end - start)

    def against_chance(self, text: str, start: int, end: int) -> tuple[float, float]:
        """Bytes that text[start:end] adds, for each of its characters; and as a share of what they add in chance order, or of what their alphabet costs if that is more."""
        own, added = text[start:end], self._added(text, start, end)
        bytes_own = added(own)
        cost = float(len(own))
        if len(own) >= CODED:
            cost = min(cost, max(added("".join(Random(own).sample(own, len(own)))), len(own) * math.log2(alphabet(own)) / 8))
        return bytes_own / len(own), bytes_own / cost


def alphabet(s: str) -> int:
    """Characters of the kinds that ``s`` is made of."""
    digits, letters = any(c.isdigit() for c in s), {c for c in s if c.isalpha()}
    low, high = any(c.islower() for c in letters), any(c.isupper() for c in letters)
    size = 6 if all(c in "abcdefABCDEF" for c in letters) else 26
    return max(2, 10 * digits + size * (low + high) + len({c for c in s if not c.isalnum()}))


def _spelling(s: str) -> str:
    """All digits are one sign, and all other signs; words in capitals are as words."""
    if not any(c.islower() for c in s):
        s = s.lower()
    return "".join(c if c.isalpha() else "0" if c.isdigit() else "-" for c in s)


@lru_cache(maxsize=1)
def _pairs() -> dict[str, float]:
    """Bits of a sign behind another, in the documentation of the language and its names."""
    from pydoc_data.topics import topics

    signs = string.ascii_letters + "0-"
    seen = Counter(a + b for run in re.findall(r"[A-Za-z0-9+/_=-]+", " ".join(topics[k] for k in sorted(topics)) + identifiers().decode()) for a, b in pairwise(_spelling(run)))
    before = {a: sum(seen[a + b] + 0.5 for b in signs) for a in signs}
    return {a + b: -math.log2((seen[a + b] + 0.5) / before[a]) for a in signs for b in signs}


def spelt(s: str) -> float:
    """Bits a character of a run's pairs of neighbours; random letters cost more than those of words."""
    bits, s = _pairs(), _spelling(s)
    return sum(bits[a + b] + (b == "0") * math.log2(10) for a, b in pairwise(s)) / max(1, len(s) - 1)


def likely(s: str) -> bool:
    """Has letters, and is spelt unlike words unless it is long and hexadecimal.  Short ones of small letters or capitals alone can't be told from words."""
    digits = any(c.isdigit() for c in s)
    if not any(c.isalpha() for c in s) or len(s) < LONG and not digits and not _inner_capital(s):
        return False
    return len(s) >= LONG and digits and not set(s) - set(string.hexdigits) or spelt(s) >= LEAST_SPELT


def novel_spans(text: str, base: list[S.Span], novelty: Novelty, least: float = LEAST_NOVELTY) -> list[tuple[S.Span, float]]:
    """Incompressible strings in a sensitive surrounding that no base span covers."""
    if not _sensitive(text.lower()):
        return []
    found: list[S.Span] = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        name = m[0].rstrip("=").rpartition("=")[0]  # a run may hold what it is assigned to
        if _sensitive(f"{text[max(0, s - NEAR) : s]}{name} {text[e : e + NEAR]}".lower()) and likely(m[0]):
            found.append(("novel", s, e))
    measured = ((x, *novelty.against_chance(text, x[1], x[2])) for x in S.apart(found, base))
    return [(x, n) for x, n, share in measured if share >= least]


def scan(text: str | None, novelty: Novelty) -> tuple[list[S.Span], list[S.Span], list[float]]:
    """Base spans; all spans by start, then kind; and the novelty of each."""
    text = text or ""
    base = base_spans(text)
    score = {x: novelty.of(text, x[1], x[2]) for x in base}
    more = dict(novel_spans(text, base, novelty))
    score |= more
    spans = sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0])))
    return base, spans, [score[x] for x in spans]


def _run(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(window, names)
        for batch in batches:
            rows = [scan(t, novelty) for t in batch.column(1).to_pylist()]
            count = [pa.array([sum(x[0] == k for x in base) for base, _, _ in rows], pa.int64()) for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *count, pa.array([S.digest(b) for b, _, _ in rows]), pa.array([S.joined(a) for _, a, _ in rows]), pa.array([[round(v, 4) for v in n] for _, _, n in rows], pa.list_(pa.float64()))],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "novelty"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, dictionary: int = DICTIONARY) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, joined), novelty (array)."""
    _io.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    names = corpus_identifiers(docs.select("text"), dictionary)
    return docs.mapInArrow(_run(window, names), f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, novelty array<double>")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
