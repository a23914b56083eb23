"""Toxicity, secrets, mixing, SentencePiece and the pipeline."""

import hashlib
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from terrazzo.llm import mixing, secret_scan, spiece, toxicity


def test_grammar():
    model = toxicity.Model({"fool": 1.0, "dolt*": 0.9})
    at = {e: k for k, e in enumerate(toxicity.EVENTS)}
    x = model.events("You are a fool. He is not a fool; she said he is a fool! Doltish. We will kill you.")
    assert x[at["insult_targeted"]] == 1 and x[at["insult_negated"]] == 1 and x[at["insult_reported"]] == 1
    assert x[at["insult"]] == 0.9 and x[at["threat"]] == 1
    assert model.events("foolish talk").sum() == 0 and model.events("").sum() == 0
    assert not toxicity.Model().events("You fool").any()


def test_learning(frame, spark, odd, none):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice("sun moon star rain wind leaf tree rock sand hill".split()) for _ in range(30))
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.2
        rows.append((i, plain() + (". You are a " + rng.choice(["blorg", "blorgish", "fleeb"]) + ". " if bad else ". ") + plain()))
        labels.append((i, int(bad)))
    docs, lab = frame(rows), spark.createDataFrame([*labels, (None, 1), (7, None), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i] == bool(b) for i, b in labels if i in held) and held
    flags = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert {i for i, h in flags.items() if h} == set(held)
    assert toxicity.reject(docs, model).count() == sum(not b for _, b in labels)
    assert toxicity.score(odd, model).count() == 11 and toxicity.reject(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(docs, lab.where("toxic > 5")).terms == {}
    # Terms of held-out rows are not learned.
    only = spark.createDataFrame([(i, b) for i, b in labels if i in held], "doc_id long, toxic int")
    assert toxicity.fit(docs, only).terms == {}


def brute_events(model, text):
    """The grammar read off its description: what is in force at each word, clause by clause."""
    out = dict.fromkeys(toxicity.EVENTS, 0.0)
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        kind = []
        for w in words:
            insult = max([model.terms.get(w, 0.0)] + [model.terms.get(w[:k] + "*", 0.0) for k in (4, 5, 6) if len(w) >= k])
            kind.append("i" if insult else "t" if w in toxicity.THREATS else "p" if w in toxicity.TARGETS else "n" if w in toxicity.NEGATIONS else "r" if w in toxicity.REPORTS else "o")
            before = lambda c, reach, k=len(kind) - 1: c in kind[max(0, k - reach) : k]
            under = "_reported" if "r" in kind[:-1] else "_negated" if before("n", 3) else ""
            if kind[-1] == "i":
                out["insult" + (under or ("_targeted" if before("p", 4) else ""))] += insult
            if kind[-1] == "p" and before("t", 4):
                out["threat" + under] += 1.0
    return [out[e] for e in toxicity.EVENTS]


def test_events_against_a_plain_reading():
    rng = random.Random(21)
    model = toxicity.Model({"fool": 1.0, "dolt*": 0.9, "scoundr*": 0.95})
    words = "you he the a not never said says kill burn fool doltish scoundrel tree house walks . ! ; \n".split(" ")
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))
        assert model.events(text).tolist() == pytest.approx(brute_events(model, text))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.op3(spark, d).join(labels.where("toxic is not null"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    toxic, clean = n.get((1, 1), 0) + n.get((1, 0), 0), n.get((0, 1), 0) + n.get((0, 0), 0)
    assert toxic > 50 and n.get((1, 1), 0) >= 0.9 * toxic and n.get((0, 1), 0) <= 0.02 * clean


def test_labels_of_one_kind_reject_nothing(frame, spark):
    docs = frame([(k, f"a plain text about rain number {k}") for k in range(40)])
    for rows in ([], [(k, 0) for k in range(40)], [(k, 1) for k in range(40)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert toxicity.reject(docs, model).count() == 40


def test_rare_toxic_rows_are_in_the_sample(frame, spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_ROWS", 100)
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice("sun moon star rain wind leaf tree rock sand hill".split()) for _ in range(9))
    bad = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 4 != 2][:6]
    docs = frame([(k, plain() + (". You are a blorg. " if k in bad else ". ") + plain()) for k in range(2000)])
    labels = spark.createDataFrame([(k, int(k in bad)) for k in range(2000)], "doc_id long, toxic int")
    rows, (clean, toxic) = toxicity.sample(docs, labels)
    assert rows.count() == 100 and rows.where("toxic = 1").count() == 6 and toxic < 1 < clean
    assert "blorg" in toxicity.fit(docs, labels).terms
    assert toxicity.reject(docs, toxicity.fit(docs, labels)).count() == 1994


def test_base_secrets(frame, odd, none):
    text = "é Password = 'abc123' token:short api_key=ABCdef99 x AKIA" + "B" * 16 + " AKIAB deadbeefdeadbeefdeadbeef0 SECRET: \"q1w2e3\" paſſword=zzzzzzzz"
    got = {r.doc_id: r for r in secret_scan.scan(frame([(1, text)])).collect()}[1]
    spans = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(?:[Pp]assword|[Tt]oken|api_key|SECRET)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    spans += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    want = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: s[0]))
    assert (got.n_assign, got.n_access, got.n_hex) == (3, 1, 1)
    assert got.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(got.spans.split(","))
    assert secret_scan.scan(odd).count() == 11 and secret_scan.scan(none).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in secret_scan.scan(odd).collect()} == {empty}


def test_guess_costs():
    guesser = secret_scan.Guesser({"information": 300, "configuration": 900, "bonjour": 500, "monde": 700})
    digits = guesser.digits
    assert digits("password") < digits("passw0rd") < digits("xK9#qLw2")
    assert digits("qwertyuiop") < 5 and digits("aaaaaaaaaa") < 5 and digits("20240131") < 6 and digits("abcabcabcabc") < 6
    assert digits("Tz81kQpWm03x") > 12 and digits("") == 0
    assert digits("x" * 5000) < 8 and digits("Az9" + "q7W" * 2000) < 14
    assert digits("configuration") < 4 and digits("bonjourmonde") < 8 and digits("Information2024") < 8
    text = "login ok; pwd: hunter-Zx81 and bearer password1, see https://u:Qp9zLmW2@host/ token: configuration"
    found = {text[a:b] for a, _, b in secret_scan.guessed_spans(text, guesser)}
    assert found == {"hunter-Zx81", "Qp9zLmW2"}


def brute_digits(guesser, value):
    """Every segmentation into the spans that the price list names, by recursion."""
    from functools import cache

    join, low = math.log10(2), value.lower()
    plain = low.translate(secret_scan._LEET)
    walk = [(a, b) in secret_scan._NEXT for a, b in zip(low, low[1:])]
    step = [ord(b) - ord(a) for a, b in zip(value, value[1:])]

    def cost(a, b):
        part = value[a:b]
        out = [sum(math.log10(secret_scan._pool(c)) for c in part)]
        for word, more in ((low[a:b], 0), (plain[a:b], join)):
            if word in guesser.ranks:
                caps = sum(c.isupper() for c in part)
                out.append(math.log10(guesser.ranks[word]) + more + (0 if not caps else join if caps in (1, b - a) else join * caps))
        m = secret_scan._DATE.match(value, a)
        if m and (b == a + 4 or b == m.end()):
            out.append(math.log10(120 * (1 if b - a == 4 else 12 if b - a < 8 else 366)))
        if b - a >= 3:
            if len(set(part)) == 1:
                out.append(math.log10(secret_scan._pool(part[0]) * (b - a)))
            if all(walk[a : b - 1]) or set(step[a : b - 1]) in ({1}, {-1}):
                out.append(math.log10(48 * (b - a)))
        for size in range(2, min(secret_scan.MAX_UNIT, (b - a) // 2) + 1):
            if (b - a) % size == 0 and part == part[:size] * ((b - a) // size):
                out.append(brute_digits(guesser, part[:size]) + math.log10((b - a) // size))
        return min(out)

    @cache
    def best(b):
        return 0.0 if b == 0 else min(best(a) + join + cost(a, b) for a in range(b))

    return best(len(value))


def test_guess_costs_against_all_segmentations():
    rng = random.Random(8)
    guesser = secret_scan.Guesser({"stone": 40, "river": 9, "tone": 800})
    bits = ["stone", "River", "r1ver", "aaaa", "qwert", "2024", "20240131", "abab", "xyzxyz", "K", "7", "#", "cba", "password"]
    close = 0
    for _ in range(300):
        value = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 5)))
        fast, full = guesser.digits(value), brute_digits(guesser, value)
        # Stretches and repeats are taken whole from inside, so a price may lie above the full search, by little.
        assert full - 1e-9 <= fast <= full + 1.0
        close += fast <= full + 1e-9
    assert close >= 285


def test_very_long_values_take_linear_time(frame):
    rng = random.Random(9)
    letters = "".join(map(chr, range(33, 127)))
    longs = ["=" * 100_000, "ab" * 50_000, "qwertyuiop" * 10_000, "".join(rng.choice(letters) for _ in range(100_000)), "password" * 12_500]
    for value in longs:
        took = {}
        for n in (25_000, 100_000):
            guesser = secret_scan.Guesser()
            began = time.process_time()
            guesser.digits(value[:n])
            took[n] = time.process_time() - began
        assert took[100_000] < 10 * max(took[25_000], 0.02), (value[:10], took)
    got = secret_scan.scan(frame([(1, "secret: " + longs[0]), (2, "pwd=" + longs[3].replace(" ", ""))]), {}).collect()
    assert len(got) == 2


def test_word_ranks(frame, none):
    rng = random.Random(18)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "ijklmnop"]
    rows = [(k, " ".join(rng.choice(words[: 4 + k % 60]).upper() for _ in range(30)) + " password=verysecretvalue") for k in range(60)]
    counts = {}
    for _, t in rows:
        for w in t.split()[:-1]:
            counts[w.lower()] = counts.get(w.lower(), 0) + 1
    counts["password"] = 60
    want = sorted(counts, key=lambda w: (-counts[w], w))
    for keep in (5, 1000):
        assert secret_scan.word_ranks(frame(rows), keep) == {w: k + 1 for k, w in enumerate(want[:keep])}
    assert secret_scan.word_ranks(none) == {}


def test_planted_values(frame):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 11))) for _ in range(300)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(40))
    secret = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!@#$") for _ in range(rng.randrange(10, 25)))
    weak = lambda: rng.choice([rng.choice(words), rng.choice(words).title() + "1", "qwerty123", "aaaaaaa", "2024-01-31", rng.choice(words) + "2024"])
    rows, want = [], []
    for k in range(400):
        bad = k % 2
        rows.append((k, f"{prose()} {rng.choice(['password: ', 'pwd=', 'token = '])}{secret() if bad else weak()} {prose()}"))
        want.append(bool(bad))
    got = {r.doc_id: "guess" in r.spans for r in secret_scan.scan(frame(rows)).collect()}
    assert sum(got[k] for k in range(400) if want[k]) >= 198 and sum(got[k] for k in range(400) if not want[k]) <= 4


@pytest.mark.parametrize(
    "text, value",
    [
        ("password: Xk9#vLq2$wRz7", "Xk9#vLq2$wRz7"),
        ("token=a1!b2@c3#d4$e5", "a1!b2@c3#d4$e5"),
        ('password="$ecr3t!Kx9@qz"', "$ecr3t!Kx9@qz"),
        ("dbpassword = Xk9#vLq2$wRz7, and", "Xk9#vLq2$wRz7"),
        ("/get?api_key=Zq81kLw0xx&page=2", "Zq81kLw0xx"),
        ("pwd: xK9#qL", "xK9#qL"),
        ("ftp://u:xK9#qL@host", "xK9#qL"),
    ],
)
def test_whole_values_are_priced(text, value):
    assert {text[a:b] for a, _, b in secret_scan.guessed_spans(text, secret_scan.Guesser())} == {value}


def brute_targets(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    clamped = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in clamped)
        free = [s for s in names if s not in clamped]
        level = left / sum(w[s] for s in free) if free else 0
        new = {s for s in free if level * w[s] > cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in clamped else level * w[s] for s in names}
        clamped |= new


def test_mixing(frame, monkeypatch):
    monkeypatch.setattr(mixing, "STRATUM", 16)
    rng = random.Random(2)
    for seed in range(3):
        scale = {f"s{k}": 10 ** rng.uniform(0, 2) for k in range(6)} | {None: 8}
        rows = [(k, " ".join("w" * rng.randrange(0, int(scale[s]) + 2)), s) for k in range(400) for s in [rng.choice(list(scale))]]
        df = frame(rows)
        sizes = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(t.split())
        want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
        got = {r.doc_id: r for r in mixing.mix(df).collect()}
        taken = {}
        for i, t, s in rows:
            r = got[i]
            assert r.size == len(t.split()) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
            assert 0 <= r.taken <= 2 * r.size
            taken[s] = taken.get(s, 0) + r.taken
        strata = 400 / 16 + 8
        assert all(abs(taken[s] - want[s]) <= strata for s in want)
        assert {r.doc_id: r.taken for r in mixing.mix(df.repartition(5)).collect()} == {i: r.taken for i, r in got.items()}
        out = mixing.apply(df)
        assert out.columns == df.columns
        words = out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
        assert {r.doc_id: r.n for r in words} == {i: r.taken for i, r in got.items() if r.taken}


def test_mixing_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and {r.taken for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(none).count() == 0 and mixing.apply(none).count() == 0
    assert mixing.apply(odd).columns == odd.columns


@pytest.fixture(scope="module")
def model():
    return spiece.Model(spiece.load(spiece.default_model()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=spiece.default_model())


def samples():
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "▁", "\n", "é", "漢字", "😀", "\x00", "<s>", "<0x41>", "\t", "12", "🇫🇷", "ing", ".", "!!"]
    return ["", " ", "▁", "hello world", "x" * 300, " " * 90, *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(400))]


def test_encoding_equals_the_library(model, library):
    for text in samples():
        ids = library.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)
        n, a, b, c = model.digest(text)
        assert (n, a) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert b == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        ends = b"".join(e.to_bytes(4, "little") for _, _, e in model.encode_spans(text))
        assert c == hashlib.sha256(ends).hexdigest()


def test_broken_bytes_decode_like_the_library(model, library):
    rng = random.Random(6)
    some = [model.bytes[b] for b in (0x41, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0xC3)] + library.encode("a b é")
    for _ in range(300):
        ids = [rng.choice(some) for _ in range(rng.randrange(1, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_spans_cover_the_source(model):
    for text in samples():
        spans, b = model.encode_spans(text), text.encode()
        if spiece.SPACE not in text:
            assert b"".join(b[x:y] for _, x, y in spans) == b
        ids, ends, back = model.arrays(text)
        assert ids.tolist() == [i for i, _, _ in spans] and ends.tolist() == [e for _, _, e in spans]


def test_new_words_are_merged_together(model, library, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice(["th", "e", "an", "er", "ß", "é", "ing", "x", "q", "...", "###"]) for _ in range(rng.randrange(1, 20))) for _ in range(4000)]
    texts = [*(" ".join(rng.choices(words, k=60)) for _ in range(300)), "", "a ▁ b", "abc" * 4000, "x  y   z", *samples()]
    parts = [w.replace(" ", spiece.SPACE) for w in {" " + w.split(".")[0].split("#")[0] for w in words} if 1 < len(w)]
    parts = [p for p in parts if all(ab in model.pairs for ab in zip(p, p[1:]))]
    symbols, counts = model.merge_many(parts)
    pieces = [model.pieces[i] for i in symbols]
    assert len(parts) > 400 and pieces == [x for p in parts for x in model.merge(p)] and counts.tolist() == [len(model.merge(p)) for p in parts]
    calls = []
    monkeypatch.setattr(spiece.Model, "merge", lambda self, chunk, f=spiece.Model.merge: calls.append(chunk) or f(self, chunk))
    fresh = spiece.Model(spiece.load(spiece.default_model()))
    fresh.digests(texts[:300])
    # Before, a merge of its own for each word; now only single characters outside all pairs.
    assert all(len(c) == 1 for c in calls) and len(calls) < 10
    # Forgetting changes nothing.
    monkeypatch.setattr(spiece, "CACHE", 500)
    monkeypatch.setattr(spiece, "AT_ONCE", 3000)
    for text, (ids, _, listed, back), (n, *_) in zip(texts, fresh.aligned(texts), fresh.digests(texts), strict=True):
        assert ids.tolist() == library.encode(text) and listed == ",".join(map(str, ids)) and back == library.decode(ids.tolist()) and n == len(ids)
    fresh._forget()
    assert 0 < len(fresh.known) <= 250 and list(fresh.known.values()) == list(range(len(fresh.known)))


def trie(entries):
    """A double-array trie over a few keys, laid out by hand: every node's children start at a base of their own."""
    import struct

    strings, at = b"", {}
    for k, v in entries.items():
        at[k] = len(strings)
        strings += v + b"\0"
    nodes = {b""} | {k[:n] for k in entries for n in range(1, len(k) + 1)}
    units, base, nxt = [0] * (256 * (len(nodes) + 2)), {}, 256
    for node in sorted(nodes, key=len):
        base[node] = nxt
        nxt += 256
    place = {b"": 0}
    for node in sorted(nodes - {b""}, key=len):
        place[node] = base[node[:-1]] ^ node[-1]
    for node in nodes:
        offset = place[node] ^ base[node]
        leaf = 256 if node in entries else 0
        units[place[node]] = (offset << 10) | leaf | (node[-1] if node else 0)
        if node in entries:
            units[base[node]] = (1 << 31) | at[node]
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings


def test_longest_prefix_normalisation():
    charmap = spiece.CharMap(trie({b"a": b"X", b"ab": b"YZ", "ﬁ".encode(): b"fi", b"q": b""}))
    assert charmap.longest(b"abc", 0) == (2, b"YZ") and charmap.longest(b"ac", 0) == (1, b"X") and charmap.longest(b"zz", 0) is None
    model = spiece.Model.__new__(spiece.Model)
    model.charmap, model.prefix, model.squeeze, model.escape = charmap, True, True, True
    text, starts, ends = model.normalise(" ab  q  ﬁa ")
    assert text == "▁YZ▁fiX"
    b = " ab  q  ﬁa ".encode()
    assert [b[s:e].decode() for s, e in zip(starts, ends)][1:3] == ["ab", "ab"] and b[starts[4] : ends[4]].decode() == "ﬁ"


def test_token_tables(odd, none, model):
    path = spiece.default_model()
    assert spiece.encode_digests(odd, path).count() == 11 and spiece.encode_digests(none, path).count() == 0
    rows = {r.doc_id: r for r in spiece.encoded(odd, path).collect() if r.doc_id != 5}
    assert rows[1].ids == [] and rows[2].decoded == "" and rows[4].decoded == "one" and rows[None].decoded == "no id at all"
    assert {r.doc_id: r.ids for r in spiece.tokens(odd, path).collect() if r.doc_id == 4} == {4: model.encode("one")}


def test_pipeline(spark):
    import corpus_pipeline
    from terrazzo.llm import simhash

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        seen[name] = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "simhash":
            assert simhash.similar(out).where("doc_id <> component_id").count() == 0
        docs = out
    assert seen["toxicity"] >= seen["simhash"] > 0 and seen["sentencepiece"] == seen["mixing"]
    assert corpus_pipeline.run(spark, d).count() == seen["sentencepiece"]
