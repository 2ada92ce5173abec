"""Personal data by weak supervision.

Candidates are the base patterns (e-mail, IP address, payment card, phone) and looser forms of
them: e-mail addresses in words, every other run of 7 to 19 digits whatever its separators, and inside
runs that no base span covers the groups that are written as cards (so of two cards with a blank between
them, which are one run too long to be a card, each is a candidate).  Six labelers vote for, against or
not at all on each candidate: the form (a regular expression for the candidate alone), a checksum or
range test, a gazetteer (top-level domains, calling codes, issuer digits, reserved networks), the words
around, the digits themselves, and the borders.  No labeled data is used:

1. all documents' candidates are reduced to counts of (kind, votes, features), a table whose size
   the number of codes bounds;
2. expectation-maximisation on these counts estimates, for each kind, how often each labeler votes
   how on true and on false candidates, and with that the probability of each vote pattern.  Only how
   seldom a true candidate fails its test is given (``SLIP``): a checksum isn't an opinion;
3. a logistic classifier of spans is trained on the counts, with these probabilities as soft
   labels; its features include what no labeler sees (length, separators);
4. candidates that the classifier accepts are added.  Base spans always stay.

Defined results
---------------
* A null text counts as empty and has no spans.  Every row gives one row, also where ids repeat;
  an empty table gives no rows; other columns do not matter.
* Base spans: leftmost, non-overlapping matches of each kind; matches that fail the kind's test are
  dropped and the search goes on behind them.  Spans of different base kinds may overlap.
* Added spans overlap no base span and no other added span.
* With no candidates, or with those of one pattern only, the probabilities are those of the priors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import spans as S

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns.  They are written so that no start is tried twice within a run of digits.
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z").search
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer

# Looser forms.
_spelt = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]{2,63})+", re.I).finditer
_masked = re.compile(r"[(\[{](?:at|dot)[)\]}]| dot ", re.I).search
_digit_runs = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]++\)?+(?:[ ./-]\(?[0-9]++\)?+|\([0-9]++\))*+(?![0-9A-Za-z])").finditer
_groups = re.compile(r"[0-9]+").finditer
#: How cards are grouped, besides one group of 13 to 19 digits.
GROUPINGS = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4))
#: A candidate alone, as its kind is mostly written.
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").fullmatch,
    "ip": re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}").fullmatch,
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}([ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}").fullmatch,
    "phone": re.compile(r"(\+|00)[0-9][ 0-9().-]+[0-9]|\(0?[0-9]{2,4}\)[ 0-9-]+").fullmatch,
}

#: Common top-level domains, first digits of calling codes with their lengths, first digits of card issuers.
TLDS = frozenset("com org net edu gov mil int info biz io co ai app dev uk de fr es it nl be ch at se no dk fi pl cz pt gr ie eu us ca mx br ar cl au nz jp cn kr in ru tr za il".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98", "351", "352", "353", "354", "358", "420", "421", "971", "972")
ISSUERS = ("3", "4", "5", "6", "2")
FOR = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address", "ping", "client"),
    "card": ("card", "visa", "credit", "pay", "amex", "iban"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "contact", "whatsapp"),
}
AGAINST = ("version", "isbn", "release", "chapter", "invoice", "order", "section", "part no", "serial", "rfc")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[S.Span]:
    """Base spans by kind as listed, then start."""
    found: list[S.Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        # The local part is the run before the sign, back to the last match at most; long runs are taken in steps.
        lo, step = at, 64
        while lo > end and (m := _local(text, max(end, lo - step), lo)):
            full = m.start() == max(end, lo - step)
            lo, step = m.start(), step * 2
            if not full:
                break
        m = _domain(text, at + 1) if lo < at else None
        if m:
            found.append(("email", lo, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _ip(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _card(text):
        d = _digits(m[0])
        if len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _phone(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def loose_spans(text: str) -> list[S.Span]:
    """Candidates beyond the base patterns."""
    found: list[S.Span] = []
    if _masked(text):
        found += [("email", *m.span()) for m in _spelt(text) if _masked(m[0])]
    for m in _digit_runs(text):
        n = sum(c.isdigit() for c in m[0])
        if n < 7:
            continue
        cards = _cards(m[0], m.start())
        if cards:
            found += cards
        elif n <= 19:
            found.append(("phone" if n < 13 or m[0].startswith("00") and n <= 17 else "card", *m.span()))
    return found


def _cards(run: str, at: int) -> list[S.Span]:
    """Groups of a run of digits that are written as cards, from the left: those that pass Luhn, else single groups."""
    groups = [m.span() for m in _groups(run)]
    size = [e - s for s, e in groups]
    out, k = [], 0
    while k < len(groups):
        ends = [k + len(g) for g in GROUPINGS if tuple(size[k : k + len(g)]) == g] + ([k + 1] if 13 <= size[k] <= 19 else [])
        end = next((e for e in sorted(ends, reverse=True) if luhn(_digits(run[groups[k][0] : groups[e - 1][1]]))), k + 1 if 13 <= size[k] <= 19 else 0)
        if end:
            out.append(("card", at + groups[k][0], at + groups[end - 1][1]))
        k = end or k + 1
    return out


def votes(text: str, span: S.Span) -> tuple[int, ...]:
    """-1, 0 or 1 of each labeler."""
    kind, s, e = span
    raw = text[s:e]
    d = _digits(raw)
    near = text[max(0, s - 40) : s].lower() + " " + text[e : e + 20].lower()
    test = gazetteer = 0
    if kind == "email":
        tail = re.split(r"\.| dot |[(\[{]dot[)\]}]", raw.lower())[-1].strip()
        test, gazetteer = (1 if 2 <= len(tail) <= 24 and tail.isalpha() else -1), (1 if tail in TLDS else 0)
    elif kind == "ip":
        parts = raw.split(".")
        test = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        gazetteer = -1 if parts[0].lstrip("0") in ("", "127") else 1 if parts[0] in ("10", "192", "172") else 0
    elif kind == "card":
        test, gazetteer = (1 if luhn(d) else -1), (1 if d[0] in ISSUERS else -1)
    else:
        code = d[2:] if raw.startswith("00") else d
        test = 1 if 8 <= len(code) <= 15 else -1
        gazetteer = (1 if code.startswith(CALLING) else -1) if raw[0] == "+" or raw.startswith("00") else 0
    context = 1 if any(w in near for w in FOR[kind]) else -1 if any(w in near for w in AGAINST) else 0
    shape = 0 if not d or kind in ("email", "ip") else -1 if len(set(d)) <= 2 or d in "01234567890123456789" else 1
    before, after = text[s - 1 : s], text[e : e + 1]
    border = -1 if before.isalnum() or after.isalnum() else 1
    return 1 if FORMS[kind](raw) else -1, test, gazetteer, context, shape, border


LABELERS, TEST = 6, 1
#: How often a true candidate fails its checksum or range test (a slip of the writer).
SLIP = 1e-4


def _passes(votes: np.ndarray) -> np.ndarray:
    """Shares of a true candidate's votes (against, none, for), with SLIP against."""
    return np.array([SLIP, *(votes[1:] / votes[1:].sum() * (1 - SLIP))])


def code(text: str, span: S.Span) -> int:
    """Kind, votes and features of a candidate in one number."""
    kind, s, e = span
    raw = text[s:e]
    out = KINDS.index(kind)
    for v in votes(text, span):
        out = out * 3 + v + 1
    separators = sum(c in " ./-()" for c in raw)
    return (out * 4 + min(3, (e - s) // 8)) * 4 + min(3, separators)


def decode(value: int) -> tuple[int, list[int], int, int]:
    value, separators = divmod(value, 4)
    value, length = divmod(value, 4)
    ballot = []
    for _ in range(LABELERS):
        value, v = divmod(value, 3)
        ballot.append(v)
    return value, ballot[::-1], length, separators


class Classifier:
    """Reliabilities by expectation-maximisation, then a logistic model; both on counts of codes."""

    def __init__(self, counts: dict[int, int], rounds: int = 60):
        codes = sorted(counts)
        n = np.array([counts[c] for c in codes], np.float64)
        parts = [decode(c) for c in codes]
        kind = np.array([p[0] for p in parts], np.int64)
        ballot = np.array([p[1] for p in parts], np.int64).reshape(len(codes), LABELERS)
        soft = np.clip(0.5 + (ballot - 1).sum(axis=1) / (2 * LABELERS + 2), 0.05, 0.95)
        #: reliability[kind][labeler][truth][vote]
        self.reliability = np.full((len(KINDS), LABELERS, 2, 3), 1 / 3)
        for _ in range(rounds if len(codes) else 0):
            logit = np.zeros(len(codes))
            for k in range(len(KINDS)):
                own = kind == k
                if not own.any():
                    continue
                true = n[own] * soft[own]
                false = n[own] - true
                prior = (true.sum() + 1) / (n[own].sum() + 2)
                logit[own] = np.log(prior / (1 - prior))
                for j in range(LABELERS):
                    for truth, weight in ((1, true), (0, false)):
                        seen = np.bincount(ballot[own, j], weights=weight, minlength=3) + (np.array([0.5, 1, 1.5]) if truth else np.array([1.5, 1, 0.5]))
                        self.reliability[k, j, truth] = seen / seen.sum()
                    if j == TEST:  # next to proof: not estimated
                        self.reliability[k, j, 1] = _passes(self.reliability[k, j, 1])
                    ratio = np.log(self.reliability[k, j, 1] / self.reliability[k, j, 0])
                    logit[own] += ratio[ballot[own, j]]
            soft = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        x = np.array([self.features(*p) for p in parts]).reshape(len(codes), 1 + len(KINDS) + 3 * LABELERS + 8)
        self.weights = np.zeros(x.shape[1])
        for _ in range(25 if len(codes) else 0):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            w = n / n.sum()
            grad = x.T @ (w * (p - soft)) + 1e-4 * self.weights
            hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
            self.weights -= np.clip(np.linalg.solve(hess, grad), -2, 2)
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))) if len(codes) else []
        self.probability = dict(zip(codes, (float(v) for v in p), strict=True))

    @staticmethod
    def features(kind: int, ballot: list[int], length: int, separators: int) -> np.ndarray:
        out = np.zeros(1 + len(KINDS) + 3 * LABELERS + 4 + 4)
        out[0] = out[1 + kind] = 1
        for j, v in enumerate(ballot):
            out[1 + len(KINDS) + 3 * j + v] = 1
        out[-8 + length] = out[-4 + separators] = 1
        return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, base and loose candidates with their codes."""
    for batch in batches:
        found = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            loose = S.apart(loose_spans(text), base)
            found.append([{"kind": x[0], "s": x[1], "e": x[2], "base": strict, "code": code(text, x)} for xs, strict in ((base, True), (loose, False)) for x in xs])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("base", pa.bool_()), ("code", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "found"])


def _decide(probability: Broadcast, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = probability.value
        for batch in batches:
            rows = []
            for found in batch.column(1).to_pylist():
                base = [(x["kind"], x["s"], x["e"]) for x in found if x["base"]]
                more = [(x["kind"], x["s"], x["e"]) for x in found if not x["base"] and of.get(x["code"], 0.0) >= least]
                every = sorted({*base, *more}, key=lambda x: (KINDS.index(x[0]), x[1]))
                rows.append((base, every))
            count = [pa.array([sum(x[0] == k for x in base) for base, _ in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *count, pa.array([S.digest(b) for b, _ in rows]), pa.array([S.joined(a) for _, a in rows])], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, joined)."""
    _io.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    found = _io.materialise(docs.mapInArrow(_candidates, f"id {kind}, found array<struct<kind:string,s:bigint,e:bigint,base:boolean,code:bigint>>"), "candidates")
    counts = found.select(F.explode("found.code").alias("code")).groupBy("code").count().collect()  # at most as many rows as there are codes
    model = Classifier({r["code"]: r["count"] for r in counts})
    probability = docs.sparkSession.sparkContext.broadcast(model.probability)
    return found.mapInArrow(_decide(probability, least), f"id {kind}, " + "".join(f"n_{k} bigint, " for k in KINDS) + "base_sha256 string, spans string")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
