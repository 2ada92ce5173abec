"""Tokens, spans, HTML, scores."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from millrace.llm import _kernel as K
from millrace.llm import bpe, html_text, kneser_ney, pii, secrets, spans, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "É" * 3000), (904, "ab " * 40_000), (905, "a@b.c, +1 (555) 123-4567; 4111 1111 1111 1111"), (905, "a@b.c, +1 (555) 123-4567; 4111 1111 1111 1111")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, spans int").repartition(3)


# ---- kernel


@given(st.lists(st.text(alphabet="aB9é_ .\n日", max_size=30), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_tokens_are_those_of_the_pattern(texts):
    low, starts, ends, doc, hashes = K.tokens(*K.text_bytes(pa.array(texts, pa.string())), K.WORD)
    got = [[] for _ in texts]
    for s, e, d in zip(starts, ends, doc, strict=True):
        got[d].append(low[s:e].tobytes().decode())
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t in texts]
    assert got == want
    words = [w for t in want for w in t]
    assert len(set(words)) == len(set(hashes.tolist()))


# ---- BPE


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


@given(st.lists(st.text(alphabet=st.sampled_from("ab' s\n\t1é日!.  \xa0AZ<|>"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_equal_tiktoken(codec, tiktoken_ids, texts):
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tiktoken_ids(t) for t in texts]
    assert [codec.decode(x) for x in got] == [t.encode() for t in texts]


def test_encoding_of_a_table(spark, tiktoken_ids):
    rows = ODD + [(1, "It's 42  words,\n\n don't!"), (2, "a" * 5000), (3, " lead and trail ")]
    got = sorted((r.id, r.n_tokens, r.ids, bytes(r.decoded)) for r in bpe.encode(docs(spark, rows), RANKS, P.PATTERN).collect())
    want = sorted((i, len(tiktoken_ids(t or "")), tiktoken_ids(t or ""), (t or "").encode()) for i, t in rows)
    assert got == want
    digests = {r.id: (r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs(spark, rows), RANKS, P.PATTERN).collect()}
    assert digests[1] == (hashlib.sha256(np.array(tiktoken_ids(rows[-3][1]), "<u4").tobytes()).hexdigest(), hashlib.sha256(rows[-3][1].encode()).hexdigest())
    assert bpe.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0


@given(st.lists(st.text(alphabet=st.sampled_from("ab \x85\xa0\u1680\u2003\u2028\u3000\x1c\n日é'"), max_size=30), max_size=4))
@settings(max_examples=150, deadline=None)
def test_segments_are_whole_texts_in_order(texts):
    data, offsets = K.text_bytes(pa.array(texts, pa.string()))
    starts, ends = bpe.cut(data, offsets)
    assert b"".join(data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)).decode() == "".join(texts)
    assert {int(o) for o, n in zip(offsets[:-1], np.diff(offsets), strict=True) if n} <= set(starts.tolist())


def foreign(tmp_path, ranks, pattern):
    import tiktoken

    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + f" {r}\n".encode() for t, r in ranks.items()))
    return str(path), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


SINGLE = {bytes([b]): b for b in range(256)}


@pytest.mark.parametrize("ranks", [{b"bc": 300, b"abc": 280, b"ab": 310, b"abcabc": 270}, {b"aba": 299, b"ab": 300}, {b"ab": 290, b"ba": 280, b"abab": 281, b"aab": 279, b"bab": 270, b"babab": 269}])
def test_ranks_that_fall(tmp_path, ranks):
    """A longer token may have a lower rank than what it is made of; merges still go by rank within a piece."""
    path, want = foreign(tmp_path, {**SINGLE, **ranks}, P.PATTERN)
    rng = random.Random(1)
    texts = ["abab", *("".join(rng.choice("abcx") for _ in range(rng.randint(1, 14))) for _ in range(600))]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Codec(path, P.PATTERN).encode(texts)] == [want(t) for t in texts]


@pytest.mark.parametrize("pattern", [r"[A-Z]+|[a-z]+|\s+|.", r"[^ ]+ ?|\s+", r"\w+"])
def test_other_patterns_and_tokens_of_blanks(spark, tmp_path, pattern):
    path, want = foreign(tmp_path, {**SINGLE, b"  ": 300, b"a ": 301, b" b": 302, b"Bi": 303, b"ca": 304}, pattern)
    texts = ["one TheBigHouse camelCase", "a  b", "a b a b ", "", "日 a  \n b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Codec(path, pattern).encode(texts)] == [want(t) for t in texts]
    got = {r.id: (r.ids, bytes(r.decoded)) for r in bpe.encode(docs(spark, list(enumerate(texts))), path, pattern).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: want(t) for k, t in enumerate(texts)}
    import regex
    assert {k: v[1] for k, v in got.items()} == {k: "".join(regex.findall(pattern, t)).encode() for k, t in enumerate(texts)}


def test_texts_whose_segments_collide_are_encoded_alone(spark, tiktoken_ids, monkeypatch, tmp_path):
    rows = [(k, f"word{k} and  more {k}") for k in range(30)]
    texts = docs(spark, rows).select("doc_id", "text")
    batches = texts.toArrow().to_batches()
    monkeypatch.setattr(K, "hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) << np.uint64(40))  # all of one length are one
    codec = ("byte_bpe_multi_50k.tiktoken", P.PATTERN)
    monkeypatch.setattr(bpe, "ENCODED", 4)
    found = pa.Table.from_batches(bpe._distinct(*codec, 0)(iter([b.select(["text"]) for b in batches]))).sort_by("hash")
    assert len(list(bpe._store(*codec, f"file://{tmp_path}")(iter(found.to_batches(max_chunksize=3))))) == 1
    out = pa.Table.from_batches(bpe._run(*codec, f"file://{tmp_path}", 0, False)(iter(batches)))
    assert dict(zip(out["id"].to_pylist(), out["ids"].to_pylist(), strict=True)) == {k: tiktoken_ids(t) for k, t in rows}


# ---- secrets


def slow_secrets(text):
    text, found = text or "", []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


@given(st.lists(st.sampled_from(["password", "PassWD", "token", "TOKEN", "secret", "api_key", "APIKEY", "=", ":", " ", "\"", "'", "abcdef", "12", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "ſ", "K", ".", "\n"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_base_secrets_equal_their_patterns(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == slow_secrets(text)


def test_novel_strings_are_found_in_sensitive_places_only(spark):
    rng = random.Random(3)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(1, f"Authorization: Bearer {key} sent"), (2, f"the picture {key} of spring"), (3, "private helper function_name_of_module_1 = compress_bytes_1"), (4, "session id1id1id1id1id1id1id1id1id1id1")] + ODD
    got = {r.id: r for r in secrets.find_secrets(docs(spark, rows)).collect()}
    assert got[1].spans == f"novel:22:{22 + len(key)}" and got[1].novelty[0] > 0.72
    assert [got[i].spans for i in (2, 3, 4)] == ["", "", ""]
    assert got[900].base_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == len(rows) - 1
    found = f'token = "{"a1b2c3d4" * 5}" x'
    one = secrets.find_secrets(docs(spark, [(7, found)])).first()
    assert (one.n_assign, one.n_access, one.n_hex) == (1, 0, 1) and one.spans == spans.joined(slow_secrets(found)) and one.base_sha256 == spans.digest(slow_secrets(found))
    assert secrets.find_secrets(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("signs", "size"), [("0123456789ABCDEF", 64), ("0123456789ABCDEF", 128), ("0123456789ABCDEF", 256), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 40), ("abcdefghijklmnopqrstuvwxyz", 40), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 12)])
def test_keys_of_any_alphabet_and_length_are_found_once_or_twice(signs, size):
    rng, novelty = random.Random(7), secrets.Novelty()
    for _ in range(10):
        key = "".join(rng.choice(signs) for _ in range(size))
        for text in (f"Authorization: Bearer {key} sent", f"Authorization: Bearer {key} failed, retry with Authorization: Bearer {key}", f"session={key} and then the cookie {key} again"):
            assert text.count(key) == sum(k == "novel" and key in text[s:e] for k, s, e in secrets.scan(text, novelty)[1])


def test_the_corpus_gives_identifiers(spark):
    """Names that the documents assign are no secrets beside sensitive words; keys never become names."""
    name = "zqxwvkjTokenPfghbz"
    key = "".join(random.Random(8).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32))
    rows = [(k, f"call fetch_row(user_name = x{k}) and {key} = 1") for k in range(4)] + [(9, f"once_only = 1, the credential {key} here")]
    found = secrets.corpus_identifiers(docs(spark, rows).select("text"))
    assert found == ["fetch_row", "user_name"] or found == ["user_name", "fetch_row"]
    assert secrets.corpus_identifiers(docs(spark, rows).select("text"), 1) == found[-1:]
    got = {r.id: r.spans for r in secrets.find_secrets(docs(spark, rows)).collect()}
    at = rows[-1][1].index(key)
    assert got[9] == f"novel:{at}:{at + 32}"
    known, bare = secrets.Novelty(names=[name]), secrets.Novelty()
    text = f"the private value {name} was read"
    assert known.of(text, 18, 18 + len(name)) < bare.of(text, 18, 18 + len(name))


def test_words_beside_sensitive_ones_are_not_keys():
    novelty = secrets.Novelty()
    for word in ("internationalization", "Geschwindigkeitsbegrenzung", "myAuthTokenValue", "section-12", "covid-19", "QWERTYUIOP", "aaaaaaaaaaaaaaa1", "id1id1id1id1id1id1id1id1", "user_account_id_2024", "api_key_version_2_beta", "/usr/local/lib/python3.13/site-packages"):
        assert not secrets.scan(f"the private key of {word} was sent", novelty)[1]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 10)), max_size=8), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 10)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_added_spans_stay_apart(found, taken):
    a, b = ([("k", s, s + n) for s, n in x] for x in (found, taken))
    kept = spans.apart(a, b)
    cover = [x for x in b]
    for k in kept:
        assert all(k[2] <= s or e <= k[1] for _, s, e in cover)
        cover.append(k)
    assert all(any(x[1] < e and s < x[2] for _, s, e in cover) for x in a)


# ---- personal data


@given(st.text(alphabet=st.sampled_from("a1.@-+ 2(5)é%09\n_"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_pii_equals_its_patterns(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "a" * 100_000 + "@b.c"):
        pii.base_spans(text)
    assert pii.base_spans("a" * 100_000 + "@b.c") == [("email", 0, 100_004)]
    card = "4111 1111 1111 1111"
    assert pii.base_spans(f"x {card} y") == [("card", 2, 21)] and not pii.base_spans(f"x {card[:-1]}2 y") and not pii.base_spans("0" * 20)


GOOD = ["4845168114407329", "4550997810720808", "5500005555555559", "4111 1111 1111 1111", "3782 822463 10005"]


def test_what_is_added_and_what_is_refused(spark):
    """Each loose candidate of a table, and what became of it."""
    rng = random.Random(2)
    digits = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    fails = [x for x in (digits(16) for _ in range(200)) if not pii.luhn(x)][:80]
    rows = [(k, f"call tel +1 (555) 123-{4000 + k} or mail me{k}@example.org from ip 10.0.0.{k % 200}, pay by card {GOOD[k % 4]} now") for k in range(80)]
    rows += [(100 + k, f"word {x} word") for k, x in enumerate(fails)]  # no card by its checksum
    yes = {300: f"{GOOD[0]} {GOOD[1]}", 301: "amex card 3782 822463 10005 today", 302: "mail bob (at) example (dot) org", 303: "mail Ann.B [AT] example [DOT] com", 304: "call phone 0049 30 1234567 now"}
    no = {400: "version 10-2000-3000-4000 of chapter", 401: f"serial {fails[0]} {fails[1]}", 402: "a1b2c3 12345678901234567890123 x9", 403: "we met at noon dot", 404: "in 1995 2001 1987"}
    rows += [*yes.items(), *no.items(), *ODD]
    got = {r.id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    for i, t in rows:
        base = brute.personal(t)
        assert got[i].base_sha256 == spans.digest(base) and {spans.joined([x]) for x in base} <= set(filter(None, got[i].spans.split(",")))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
    added = {i: [t[int(s) : int(e)] for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x)] for i, t in rows if t and i not in range(80)}
    assert added[300] == [GOOD[0], GOOD[1]] and added[301] == ["3782 822463 10005"] and added[304] == ["0049 30 1234567"]
    assert added[302] == ["bob (at) example (dot) org"] and added[303] == ["Ann.B [AT] example [DOT] com"]
    assert not any(added[i] for i in [*no, *range(100, 100 + len(fails))])
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_candidates_are_found_in_linear_time():
    for text in ("1" * 200_000, "1 " * 100_000, "(1" * 100_000, "a(at)" * 40_000, "a at b dot " * 20_000, "1234 " * 40_000, "(at) " * 40_000):
        pii.loose_spans(text)


def test_reliabilities_are_learnt_from_votes_alone():
    good, bad = pii.code("call +1 (555) 123-4567 now", ("phone", 5, 22)), pii.code("version 10-20-30-40", ("phone", 8, 19))
    model = pii.Classifier({good: 900, bad: 400})
    assert model.probability[good] > 0.9 > 0.2 > model.probability[bad]
    assert pii.Classifier({}).probability == {}
    kind, ballot, length, separators = pii.decode(good)
    assert kind == 3 and len(ballot) == pii.LABELERS and separators == 3


# ---- HTML


@pytest.mark.parametrize("page, text", [
    ("<p>One <b>two</b>\n three<p>Four", "One two three\n\nFour"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  1. x\n  2. y\n- c"),
    ("<table><tr><th>Name<th>n<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name  | n\nalpha | 1\nb     | 22"),
    ("<td>loose</td> cell", "loose cell"),
    ("a &lt; b &amp; c < d<br>e", "a < b & c < d\ne"),
    ("<pre>  x\n   y</pre>", "  x\n   y"),
    ("<div hidden>no</div><p style='display:none'>no</p><div aria-hidden=true>no<div>no</div></div>yes", "yes"),
    ("<script>var x='</p>';</script><style>p{}</style><!-- no --><title>T</title>yes", "yes"),
    ("<p>a</div></span>b</p></p>c", "ab\n\nc"),
    ("<blockquote>q</blockquote>", "> q"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("text <unclosed attr='x", "text"),
    ("<textarea> raw <b> </textarea>z", " raw <b> z"),
    ("", ""),
])
def test_rendering(page, text):
    assert html_text.render(page).strip("\n") == text


@pytest.mark.parametrize("page, text", [
    ("<select><option>x<option>y</select>", "x"),
    ("<select><option>x<optgroup label=g><option selected>y</optgroup><option selected>z</select>", "y"),
    ("<select multiple><option>x<option>y</select>", "x\ny"),
    ("<table><tr><td>a<td>bbb<td>c<tr><td colspan=2>wide<td>d<tr><td colspan=x>e<td>f</table>", "a | bbb | c\nwide    | d\ne | f"),
    ("<table><tr><td><p>a<p>b<td>c<tr><td>d<td>e</table>", "a\n\nb\nc\nd | e"),
    ("<table><tr><td>" + "x" * 70 + "<td>y<tr><td>a<td>b</table>", "x" * 70 + " | y\na | b"),
])
def test_choices_and_cells(page, text):
    assert html_text.render(page).strip("\n") == text


def test_time_and_output_are_linear_in_the_page():
    for page in ("<div>" * 20_000 + "</x>" * 20_000, "<div><table>" + "<b>" * 20_000 + "</div>" * 20_000 + "</p>" * 20_000, "<ul><li>a" * 20_000, "<blockquote>a" * 20_000,
                 "<table><tr><td>" + "y" * 60 + "<td>x" * 5_000 + "<tr>" + "<td colspan=1000>z" * 2_000 + "<tr><td>" + "q<br>" * 5_000, "<table><tr>" + f"<td>{'y' * 60}" * 900 + "<tr><td colspan=900>a<td>b" * 900):
        assert len(html_text.render(page)) <= 16 * len(page)


class Sketch:
    """Random pages together with what must be seen of them, made by recursion."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def word(self):
        return "".join(self.rng.choices("abcxyz", k=self.rng.randint(1, 6)))

    def blocks(self, depth=0):
        page, seen = "", []
        for _ in range(self.rng.randint(1, 3)):
            kind = self.rng.choice(["p", "div", "list", "table", "hidden", "quote"] if depth < 3 else ["p", "hidden"])
            if kind == "p":
                w = " ".join(self.word() for _ in range(self.rng.randint(1, 4)))
                page, seen = page + f"<p>{w.replace(' ', '  <i>', 1)}</i></p>" , [*seen, None, w, None]
            elif kind == "div":
                inner, lines = self.blocks(depth + 1)
                page, seen = page + f"<div>{inner}</div>", [*seen, *lines]
            elif kind == "quote":
                inner, lines = self.blocks(depth + 1)
                page, seen = page + f"<blockquote>{inner}</blockquote>", [*seen, None, *(x if x is None else "> " + x for x in lines), None]
            elif kind == "list":
                inner, lines = self.items(0)
                page, seen = page + inner, [*seen, None, *lines, None]
            elif kind == "table":
                rows = [[self.word() for _ in range(self.rng.randint(1, 3))] for _ in range(self.rng.randint(1, 3))]
                wide = [max(len(r[k]) for r in rows if k < len(r)) for k in range(max(map(len, rows)))]
                page += "<table>" + "".join("<tr>" + "".join(f"<td>{c}" + self.rng.choice(["", "</td>"]) for c in r) + self.rng.choice(["", "</tr>"]) for r in rows) + "</table>"
                seen += [None, *(" | ".join(c.ljust(wide[k]) for k, c in enumerate(r)).rstrip() for r in rows), None]
            else:
                page += self.rng.choice(["<script>no</script>", "<div hidden><p>no<ul><li>no</ul></div>", "<!-- no -->", "<p style='display: none'>no</p>", "</span>", "<svg><p>no</p></svg>"])
        return page, seen

    def items(self, level):
        ordered, page, seen = self.rng.random() < 0.5, "", []
        for k in range(self.rng.randint(1, 3)):
            w = self.word()
            page, seen = page + f"<li>{w}", [*seen, "  " * level + (f"{k + 1}. " if ordered else "- ") + w]
            if level < 2 and self.rng.random() < 0.4:
                inner, lines = self.items(level + 1)
                page, seen = page + inner, seen + lines
            page += self.rng.choice(["", "</li>"])
        tag = "ol" if ordered else "ul"
        return f"<{tag}>{page}</{tag}>", seen


@given(st.integers(0, 10**9))
@settings(max_examples=300, deadline=None)
def test_rendering_equals_brute_force(seed):
    page, seen = Sketch(seed).blocks()
    want, gap = [], False
    for x in seen:
        if x is None:
            gap = True
        else:
            want += ["", x] if gap and want else [x]
            gap = False
    assert html_text.render(page) == "\n".join(want)


def test_nesting_has_no_limit_and_titles_are_asked_for(spark):
    assert html_text.render("<div>" * 50_000 + "x" + "</div>" * 10) == "x"
    assert html_text.render("<table>" * 300 + "<tr><td>x") .strip() == "x"
    assert html_text.render("<title>A &amp; B</title><p>c", title=True) == "A & B\n\nc"
    pages = spark.createDataFrame([(1, None, 1), (1, "<p>a", 2), (2, "", 3)], "page_id bigint, html string, text int")
    assert sorted((r.id, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(1, "", 0), (1, "a", 1), (2, "", 0)]
    assert html_text.extract(pages.where("false")).count() == 0


# ---- language model


@pytest.mark.parametrize("order", [2, 3, 4])
def test_the_model_equals_its_definition(spark, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "SHARD_NGRAMS", 20)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(60)], k=rng.randint(0, 40)))) for i in range(120)] + [(400, "many times " * 300), (401, "times many")] + [(500, None), (501, ""), (502, "Zz\tq\nw1"), (502, "Zz\tq\nw1")]
    df = docs(spark, rows)
    model = kneser_ney.train(df.where("doc_id % 3 <> 0"), order=order)
    ref = brute.KneserNey([t for i, t in rows if i % 3], order)
    n, v = sum(ref.count.values()), len(ref.count)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    got = kneser_ney.score(df, model).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        w = ref.split(text[r.id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(ref.count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((ref.count[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-9)
        assert math.isclose(r.score, ref.score(text[r.id]), abs_tol=1e-9)


def test_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b a", "a c", "b a b", "c"] * 5)]
    model = kneser_ney.train(docs(spark, rows))
    # P(w | a) = P(a w end) / (P(a | begin) P(end | w)), for all words, the end and one unknown word.
    class Open(brute.KneserNey):
        split = staticmethod(lambda text: (text or '').split())

    ref = Open([], kneser_ney.ORDER)
    ref.__dict__.update(brute.KneserNey([t for _, t in rows], kneser_ney.ORDER).__dict__)
    for context in ("a", "b", "unknown"):
        total = sum(10 ** (ref.score(f"{context} {w}") - ref.score(context)) for w in ["a", "b", "c", "</s>", "unknown"])
        assert math.isclose(total, 1, abs_tol=1e-9)
    full = brute.KneserNey([t for _, t in rows], kneser_ney.ORDER)
    assert math.isclose(kneser_ney.score(docs(spark, [(0, "a b")]), model).first().score, full.score("a b"), abs_tol=1e-9)


def test_a_model_of_nothing(spark):
    model = kneser_ney.train(docs(spark, []))
    got = kneser_ney.score(docs(spark, [(1, "a b"), (2, None)]), model).collect()
    assert {(r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}
    assert kneser_ney.score(docs(spark, []), model).count() == 0


def test_a_batch_opens_each_shard_once_for_each_order(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_NGRAMS", 20)
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=30)) for _ in range(40)]
    model = kneser_ney.train(docs(spark, list(enumerate(texts))))
    opened, mapped = [], K.mapped_arrays
    monkeypatch.setattr(K, "mapped_arrays", lambda folder, name, kinds: opened.append(name) or mapped(folder, name, kinds))

    class Shared:
        value = model

    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["id", "text"])
    assert sum(b.num_rows for b in kneser_ney._score(Shared)(iter([batch]))) == 40
    ngrams = [n for n in opened if n[0] in "23"]
    assert len(ngrams) > 20 and len(ngrams) == len(set(ngrams))


@pytest.mark.parametrize("bits", [[3, 3], [22, 22, 22], [63, 2], [2, 64, 40], [64, 64, 64, 1]])
def test_rows_are_sorted_as_single_keys_whatever_their_width(monkeypatch, bits):
    monkeypatch.setattr(np, "lexsort", None)
    rng = np.random.default_rng(5)
    pool = [rng.integers(0, 2**b, 6, np.uint64, endpoint=False) if b < 64 else rng.integers(0, 2**64 - 1, 6, np.uint64, endpoint=True) for b in bits]
    columns = [p[rng.integers(0, 6, 500)] for p in pool]
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    got, n = kneser_ney.summed(columns, np.full(500, 2))
    assert list(zip(*(c.tolist() for c in got), strict=True)) == sorted(set(rows))
    assert n.tolist() == [2 * rows.count(r) for r in sorted(set(rows))]
    got, n = kneser_ney.counted([c.astype(np.int64) for c in columns], max(bits)) if max(bits) < 63 else (got, n // 2)
    assert list(zip(*(c.tolist() for c in got), n.tolist(), strict=True)) == [(*r, rows.count(r)) for r in sorted(set(rows))]
    got, n = kneser_ney.unpack(kneser_ney.pack(got, n), len(bits))
    assert list(zip(*(c.tolist() for c in got), n.tolist(), strict=True)) == [(*r, rows.count(r)) for r in sorted(set(rows))]


@pytest.mark.parametrize("size", [0, 1, 5, 3000])
def test_stored_keys_are_found_and_no_others(size):
    rng = np.random.default_rng(size)
    key = np.unique(rng.integers(0, 2**64 - 1, size, np.uint64))
    key[: size // 2] >>= np.uint64(7)  # crowded in a few runs of the directory
    key = rng.permutation(np.unique(key))
    values = [rng.integers(1, 2 + 500 * k, len(key)) * rng.choice([1, 2**33], len(key)) for k in range(1, 5)]
    arrays = [a.astype(t) for a, t in zip(kneser_ney._coded(key, values), kneser_ney.CODED, strict=True)]
    absent = np.setdiff1d(rng.integers(0, 2**64 - 1, 2000, np.uint64), key)
    wanted = rng.permutation(np.concatenate([key, absent]))
    have = dict(zip(key.tolist(), zip(*(v.tolist() for v in values), strict=True), strict=True))
    assert list(zip(*(x.tolist() for x in kneser_ney._found(arrays, wanted, 4)), strict=True)) == [have.get(k, (0,) * 4) for k in wanted.tolist()]


# ---- toxicity


def toxic_corpus(seed=1, n=600):
    rng = random.Random(seed)
    syllables = ["an", "the", "ou", "re", "ti", "en", "sh", "ly"]
    out = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.2
        for _ in range(max(2, len(words) // 25) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["grobix", "fnord", "schmutz" + rng.choice(syllables)])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_terms_of_many_texts_are_those_of_each():
    rng = random.Random(5)
    words = ["a", "Zebra", "streets", "street", "straw", "stream", "strea", "ünïcode", "x1y", "^strea", "99"]
    texts = [None, "", "12 34", "unseen", *(" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60))]
    vocabulary = {w: i for i, w in enumerate(["a", "stream", "^strea", "zebra", "strea", "^ünïco"], 1)}
    beginning = np.array([0, *(vocabulary.get("^" + w[:5], 0) if len(w) > 5 else 0 for w in vocabulary)])
    expected = []
    for t in texts:
        own = {}
        for w, n in toxicity.terms(t).items():  # beginnings are counted on their own
            if w in vocabulary:
                own[vocabulary[w]] = own.get(vocabulary[w], 0) + n
            elif w[0] != "^" and not (len(w) > 5 and "^" + w[:5] in vocabulary):
                own[0] = own.get(0, 0) + n
        expected.append(sorted(own.items()))
    for given, together in ((beginning, 1), (beginning, 200), (None, 10**6)):
        start, feature, n = toxicity.found(texts, vocabulary, given, together)
        assert [list(zip(feature[a:b].tolist(), n[a:b].tolist(), strict=True)) for a, b in zip(start[:-1], start[1:], strict=True)] == expected
    assert [toxicity.counts(t, vocabulary) for t in texts] == expected
    assert [x.tolist() for x in toxicity.found([], vocabulary)] == [[0], [], []]


def test_held_out_accuracy_exact_search_and_odd_texts(spark):
    rows = toxic_corpus()
    df = docs(spark, [(i, t) for i, t, _ in rows] + ODD)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 1), (3, None), (4, 7)], "doc_id bigint, toxic int")
    index = toxicity.fit(df, labels.where("doc_id % 5 <> 0"))
    got = {r.id: r.score for r in toxicity.score(df, index).collect()}
    held = [(got[i] >= 0.5, bool(y)) for i, _, y in rows if i % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] < 0.5
    index = index.load()
    queries = index.matrix([tuple(toxicity.counts(t, index.vocabulary)) for _, t, _ in rows[:100]])
    _, cosine = index.nearest(queries, 15)
    weight = np.zeros((len(index.example), len(index.terms)))
    for b, (terms, weights) in enumerate(index.posting):
        weight[np.arange(weights.shape[1])[:, None] + b * index.block, terms] = weights.T
    full = -np.sort(-np.rint(np.minimum(queries @ weight.T, 1) * 1e6), axis=1)[:, :15] / 1e6
    assert np.abs(cosine - full).max() <= 1e-6


def test_scores_equal_brute_force(spark, monkeypatch):
    """Vectors, neighbours, votes and calibration; the block-max search with small blocks."""
    rows = toxic_corpus(4, 260)
    rows = [(i, t if i % 9 else " ".join(t.split()[:12]), y) for i, t, y in rows] + [(1000, "", 1), (1001, "fnord", 1)]
    df = docs(spark, [(i, t) for i, t, _ in rows] + ODD)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.id: r.score for r in toxicity.score(df, toxicity.fit(df, labels.where("doc_id % 4 <> 0"), block=8)).collect()}
    own = {}
    for i, t, y in rows:
        if i % 4:
            own.setdefault(t, (i, t, y))
    ref = brute.Toxicity(list(own.values()))
    far = {i: (got[i], ref.score(t)) for i, t, _ in [*rows, *((i, t, 0) for i, t in ODD)] if abs(got[i] - ref.score(t)) > 1e-6}
    assert not far, far


def test_an_id_labelled_both_ways_counts_as_one(spark):
    rows = toxic_corpus(6, 200)
    df = docs(spark, [(i, t) for i, t, _ in rows])
    once = [(i, y) for i, _, y in rows]
    both = [x for i, y in once for x in ((i, y), (i, 0))]
    score = lambda labels: {r.id: r.score for r in toxicity.score(df, toxicity.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))).collect()}
    assert score(both) == score(once)


def test_every_word_of_the_examples_counts(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rare = ["z" + "".join(rng.choices("klmnopqrst", k=4)) for _ in range(60)]  # each in 5 of 300 texts of label 1
    rows = []
    for i in range(1500):
        words = rng.choices(plain, k=30)
        if i % 5 == 0:
            words[rng.randrange(30)] = rare[i // 5 % 60]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    index = toxicity.fit(df, labels.where("doc_id >= 300"))
    assert set(plain + rare) <= set(index.load().terms)
    got = {r.id: r for r in toxicity.score(df.where("doc_id < 300"), index).collect()}
    held = [(got[i].score >= 0.5, y == 1) for i, _, y in rows if i < 300]
    assert sum(a and b for a, b in held) > 0.9 * 60 and sum(a and not b for a, b in held) < 0.05 * 240
    assert len({got[i].evidence for i in range(300)}) == 300


def test_fitting_on_little(spark):
    df = docs(spark, [(1, "a b"), (2, "c")])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, ones)).collect()} == {1.0}
    assert toxicity.score(docs(spark, []), toxicity.fit(df, none)).count() == 0
    kept = toxicity.reject(docs(spark, [(1, "a"), (None, "b")]), none)
    assert kept.columns == ["doc_id", "text", "spans"] and kept.count() == 2
    assert toxicity.fit(df, ones.select("doc_id", F.lit(1).alias("toxic"))).load().share == 1.0
